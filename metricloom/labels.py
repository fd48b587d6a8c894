"""Labels and header names that must match the input exactly."""

# Metrics.
ORDERS = "大定"
RETAINED = "留存大定"
RETAINED_OLD = "净大定"
LOCKED = "交车锁单"
DELIVERED = "已交付"
SMALL = "小订"
SMALL_NET = "净小订"

# Statistic kinds.
QTY = "数量"
SHARE = "占比"
STORES = "贡献门店数"
TOTAL = "总计"

# Dimensions with their own rules.
CHANNEL = "门店类型"
ACTIVE_STORES_OLD = "贡献订单门店数"
POWER = "动力"
BATTERY = "电池包"
VERSION = "版本"

# Conversion stages, first to last.
STAGES = ("大定", "留存大定", "销售锁单", "交车锁单", "已发运", "已到店", "已交付")

# Report keywords and the analysis that reads them.
REPORTS = (
    ("SKU收敛度", "sku"),
    ("大定选配比例", "order_mix"),
    ("小订选配比例", "small_order_mix"),
    ("小订退订", "cancellation"),
    ("订单7级转化", "conversion"),
    ("选配金统计", "option_fee"),
    ("锁单选配比例", "lock_mix"),
    ("首销期订单节奏", "launch_rhythm"),
)

# The order report by module name and by keyword.
ORDER_REPORTS = ("order_mix", "大定选配比例")

# Primary quantity used to weight ratios, by the word found in the report name.
PRIMARY_BY_REPORT = (
    ("锁单", "交车锁单"), ("小订", "小订"), ("大定", "大定"), ("lock_mix", "交车锁单"), ("small_order_mix", "小订"), ("order_mix", "大定"),
)

# Labels that mark a field as an addable quantity.
QUANTITY_LABELS = ("数量", "订单量", "订单数", "单量", "累计锁单")

# Words that mark a field as a ratio, an average or a duration, which can't be added.
RATIO_WORDS = ("占比", "比例", "率", "平均", "均价", "时长", "天数", "（天）", "(天)")

# Block titles that hold counts in side-by-side layouts.
COUNT_BLOCKS = ("累计锁单", "锁单数量", "订单数量")

# Words that mark a period as a summary page.
SUMMARY_MARKERS = ("近", "汇总", "累计", "总计")

# Period label of figures over all periods of a subject.
ALL_PERIODS = "all"

# Words of summary labels: totals, "the last", its units, and measures that may follow a total.
TOTAL_WORDS = ("总计", "合计", "汇总", "累计")
RECENT_WORD = "近"
DAY_WORDS = ("天", "日", "周", "月")
MEASURE_WORDS = ("占比", "比例", "数量")

# Amount bands in business order.
FREE_BAND = "免费"
BAND_ORDER = (
    "免费", "0-5000", "5000-10000", "10000-15000", "15000-以上",
    "0-10000", "10000-20000", "20000-30000", "30000-以上",
)

# Words between and behind the numbers of an amount band.
BAND_JOINS = ("至", "到", "~", "～")
BAND_BELOW = ("以下", "以内")
BAND_ABOVE = ("以上",)

# Signs of a ranked item, as character classes.
BRACKETS_OPEN, BRACKETS_CLOSE, PERCENT_SIGNS = "[（(]", "[)）]", "[%％]"

# Grain words used in sheet names.
GRAINS = {"时": "hour", "天": "day", "周": "week", "月": "month"}

# Words in sheet names: charts, net measures before the grain, kinds of analysis at the end.
CHART_WORD = "图表"
NET_MEASURES = ("净大定", "净小订")
SHEET_KINDS = ("SKU", "组合", "日度退订", "选配退订", "小订分时退订", "选配渗透率排名", "付费选配占比", "选配渗透率")

# Words in names of generations: several models together, trims, and short forms.
COMBINED_WORDS = ("总计", "汇总")
TRIM_WORDS = ("增程", "纯电", "智驾版", "标准版")
SHORT_WORDS = {"Ultimate": "U", "典藏大观": "大观"}

# Declared coverage cells.
COVERAGE_STARTS = ("数据开始日期", "统计开始日期", "导出开始日期", "数据起始日期", "统计起始日期")
COVERAGE_ENDS = (
    "数据结束日期", "数据截止日期", "统计结束日期", "统计截止日期", "导出结束日期", "导出截止日期",
)

# Header aliases per table kind: field -> accepted header texts.
HOURLY_HEADERS = {
    "date": ("小订日期", "下单日期", "日期"),
    "hour": ("小订小时", "小时", "时段"),
    "orders": ("小订数", "小订数量"),
    "cancel": ("总退订数", "退订数", "总取消数"),
}
DAILY_HEADERS = {
    "date": ("取消日期", "退订日期", "日期"),
    "small_cancel": ("当日小订退", "当日小订退订", "当日小订后退订"),
    "small_cancel_cum": ("累计小订退", "累计小订退订"),
    "big_cancel": ("当日退订数", "当日大定退", "当日大定退订"),
    "convert_rate": ("整体 - 小订转大定 %", "整体-小订转大定比例", "小订转大定比例", "小转大率"),
    "small_rate": ("整体 - 小订退 %", "整体-小订后退订%", "小订退订率"),
    "big_rate": ("整体 - 大定退 %", "整体-大定后退订%", "大定退订率"),
}
OPTION_RETREAT_HEADERS = {
    "orders": ("小订数", "小订数量"),
    "cancel": ("总退订数", "退订数", "总取消数"),
    "pre_share": ("小订后退订比例", "小订退订比例"),
    "post_share": ("大定后退订比例", "大定退订比例"),
    "share": ("总退订比例", "总退订率"),
}
PERIOD_HEADERS = ("周", "月", "周期", "统计周期")
COHORT_QUANTITY_HEADERS = ("数量", "订单量", "订单数", "单量")
COHORT_DURATION_HEADERS = {
    "order_to_lock_days": (
        "大定到交车锁单（天）", "大定到交车锁单天数", "大定至交车锁单（天）", "大定至交车锁单天数",
    ),
    "lock_to_delivery_days": (
        "交车锁单到交付（天）", "交车锁单到交付天数", "交车锁单至交付（天）", "交车锁单至交付天数",
    ),
}

# Launch metric names, primary first, then the older spelling.
LAUNCH_ORDERS = ("当日大定数量",)
LAUNCH_RETAINED = ("当日留存大定数量", "当日净大定数量")
LAUNCH_SMALL = ("当日小订转大定数量",)
LAUNCH_DIRECT = ("当日直接大定数量",)
LAUNCH_CUM_DIRECT = "累计直接大定数量"
LAUNCH_CUM_GROSS = ("累计总大定数量", "累计大定数量")
LAUNCH_CUM_SMALL = ("累计小订转大定数量", "累计小订转大数量")
LAUNCH_CUM_SMALL_RATE = ("累计小订转化率", "累计小转大率")
LAUNCH_CUM_LOCK = "累计交车锁单数量"
LAUNCH_DAY_SHARE = "每日直接大定占比"
LAUNCH_CUM_SHARE = "累计直接大定占比"
