"""Names, lists and edges that fix what the facts and views contain."""

# ---------------------------------------------------------------------------
# Source names, countries, bucket edges and labels, windows.
# They decide the result, so they are stated as they are.
# ---------------------------------------------------------------------------

INFLOW_SOURCES = (
    "rewards_race",
    "rewards_store",
    "rewards_rolling_offer_collect",
    "rewards_board_task",
    "rewards_harvest_collect",
    "rewards_missions_total",
    "rewards_recipes",
    "rewards_flowers",
    "rewards_rewarded_video",
    "rewards_disco",
    "rewards_timed_task",
    "rewards_sell_board_item",
    "rewards_mass_compensation",
    "rewards_missions_task",
    "rewards_album_set_completion",
    "rewards_self_collectable",
    "rewards_eoc",
    "rewards_frenzy_non_jackpot",
)
PAID_SOURCES = ("rewards_store", "rewards_rolling_offer_collect", "rewards_disco")
GENERATION = "generation"
BUBBLE = "click_bubble_purchase"
OUTFLOW_SOURCES = (GENERATION, BUBBLE)

INFLOW = "inflow"
OUTFLOW = "outflow"
REWARD_MARK = "rewards"
CREDIT_MARK = "credits"

EXCLUDED_COUNTRIES = ("UA", "IL", "AM")
HOME_COUNTRY = "US"

WIDE_DAYS = 14
LONG_DAYS = 7

# Inclusive integer ranges of the fact tables, and the label above all of them.
CHAPTER_RANGES = ((0, 10, "0-10"), (11, 20, "11-20"), (21, 50, "21-50"))
CHAPTER_TOP = "50+"
BALANCE_RANGES = (
    (0, 100, "0-100"),
    (101, 300, "101-300"),
    (301, 500, "301-500"),
    (501, 1000, "501-1000"),
    (1001, 3000, "1001-3000"),
    (3001, 5000, "3001-5000"),
)
BALANCE_TOP = "5000+"

# Half-open ranges of the generic bucketing helper; the last has no upper end.
CHAPTER_STEPS = ((0, 11, "0-10"), (11, 21, "11-20"), (21, 51, "21-50"), (51, None, "50+"))
BALANCE_STEPS = (
    (0, 101, "0-100"),
    (101, 301, "101-300"),
    (301, 501, "301-500"),
    (501, 1001, "501-1000"),
    (1001, 3001, "1001-3000"),
    (3001, 5001, "3001-5000"),
    (5001, None, "5000+"),
)

# Estimated events per outflow row: mode 3 counts as 6, any other mode as mode + 1.
BIG_MODE = 3
BIG_MODE_DIVISOR = 6

# Version bounds of the version-gated sum: lower inclusive, upper exclusive.
VERSION_GATE = (0.357, 0.3593)

# A winning rank is this or better.
WIN_RANK = 3

DIMENSIONS = (
    "first_chapter_bucket",
    "is_us_player",
    "last_balance_bucket",
    "last_version_of_day",
    "paid_today_flag",
    "paid_ever_flag",
)
FLAG_COLUMNS = ("paid_today_flag", "paid_ever_flag", "is_us_player")
BUCKET_COLUMNS = ("first_chapter_bucket", "last_balance_bucket")
TOTALS = ("total_inflow", "total_free_inflow", "total_paid_inflow", "total_outflow")

# ---------------------------------------------------------------------------
# Derived from the lists above.
# ---------------------------------------------------------------------------

FREE_SOURCES = tuple(s for s in INFLOW_SOURCES if s not in PAID_SOURCES)
LISTED_SOURCES = INFLOW_SOURCES + OUTFLOW_SOURCES
WIDE_KEYS = ("date",) + DIMENSIONS


def direction_of(source: str) -> str:
    return OUTFLOW if source in OUTFLOW_SOURCES else INFLOW


def value_column(source: str) -> str:
    return f"{source}_{direction_of(source)}_sum_value"


def count_column(source: str) -> str:
    return f"{source}_{direction_of(source)}_cnt"


MEASURES = tuple(make(s) for s in LISTED_SOURCES for make in (value_column, count_column))
WIDE_COLUMNS = WIDE_KEYS + ("players",) + MEASURES + TOTALS
NUMERIC_COLUMNS = ("players", "last_version_of_day") + MEASURES + TOTALS

# The columns each total adds up.
TOTAL_PARTS = {
    "total_inflow": INFLOW_SOURCES,
    "total_free_inflow": FREE_SOURCES,
    "total_paid_inflow": PAID_SOURCES,
    "total_outflow": OUTFLOW_SOURCES,
}


def check_dimension(dimension: str | None) -> None:
    if dimension is not None and dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}; one of {', '.join(DIMENSIONS)}")
