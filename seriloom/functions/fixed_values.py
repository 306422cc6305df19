"""Fixed values that results depend on, stated as plain text in one place."""

# Columns every feed must carry.
FEED_COLUMNS = [
    "COUNTRY_CODE",
    "COUNTRY_AREA_TERRITORY",
    "ISO_WEEKSTARTDATE",
    "AGEGROUP_CODE",
    "ILI_CASE",
    "ARI_CASE",
]
MIN_FEED_ROWS = 10_000
MAX_MALFORMED_SHARE = 0.01
MIN_KEPT_ROWS_SHARE = 0.5

# Parallel-reporting guard.
MIN_BOTH_WEEKS = 26
SCALE_RATIO = 10.0
MIN_WINNER_WEEKS = 156
MIN_WINNER_YEARS = 4.0

# Series cleaning.
ZERO_FLOOR = 1e-6
MAX_ZERO_RUN = 3
LEAD_WINDOW = 8
LEAD_SHARE = 0.10

# Quality screen.
MIN_WEEKS = 156
MIN_YEARS = 4
MAX_MISSING_PCT = 50.0
MIN_SCALE = 20.0

# Training windows.
CONTEXT_WEEKS = 260
TARGET_WEEKS = 4
STRIDE_WEEKS = 4
HELD_OUT_WEEKS = 104
MAX_NEIGHBOURS = 6
MIN_NEIGHBOUR_SHARE = 0.5
PEAK_LEVEL = 0.70
PEAK_REPEAT = 3
RECENCY_DECAY = 0.3
FUTURE_KNOWN = ["hemisphere", "week_sin", "week_cos", "data_type_indicator"]

# Tropics of Cancer and Capricorn used by the hemisphere flag.
TROPIC_LATITUDE = 23.5

# Weather cache upkeep.
FRESH_GAP_DAYS = 14
EXTEND_OVERLAP_DAYS = 7
WEATHER_FEATURES = ["temp_mean", "temp_max", "temp_min", "humidity_mean", "humidity_min"]

# Quantile levels and symmetric intervals (lower, upper, alpha).
LEVELS_7 = [0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975]
INTERVALS_7 = [(0.025, 0.975, 0.05), (0.1, 0.9, 0.2), (0.25, 0.75, 0.5)]
LEVELS_9 = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
LEVELS_23 = [
    0.01, 0.025, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
    0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.975, 0.99,
]
INTERVALS_23 = [
    (0.01, 0.99, 0.02), (0.025, 0.975, 0.05), (0.05, 0.95, 0.10), (0.10, 0.90, 0.20),
    (0.15, 0.85, 0.30), (0.20, 0.80, 0.40), (0.25, 0.75, 0.50), (0.30, 0.70, 0.60),
    (0.35, 0.65, 0.70), (0.40, 0.60, 0.80), (0.45, 0.55, 0.90),
]
LEVEL_TOLERANCE = 0.005

# Baseline forecaster and rolling evaluation.
HORIZON = 4
HISTORY_WEEKS = 104
MIN_POOL = 4
N_PATHS = 10_000
MIN_CONTEXT = 10
SEASON_WEEKS = 52
SEASON_PERCENTILE = 20.0
PEAK_DISTANCE = 16
PEAK_PROMINENCE = 0.3
PEAK_WINDOW = 2
PEAK_SIGNIFICANCE = 1.5
MIN_COMMON_KEYS = 4

# Published views.
STALE_DAYS = 56
FORECAST_REACH_DAYS = 56
MIN_SAME_TYPE = 13

# Covariate names of the experiment grid, in order, with their short forms.
COVARIATES = ["data_type", "hemisphere", "week_of_year", "weather", "neighbors"]
COVARIATE_SHORT = {
    "data_type": "dt",
    "hemisphere": "hemi",
    "week_of_year": "woy",
    "weather": "weather",
    "neighbors": "neighbors",
}

# Forecast-hub seasons (start year, start week, end year, end week, indicator).
SEASONS = {
    "2023-24": (2023, 46, 2024, 13, "ILI"),
    "2024-25": (2024, 45, 2025, 16, "ILI"),
    "2025-26": (2025, 46, 2026, 13, "ARI"),
}

# Official name -> short name.
SHORT_NAMES = {
    "Côte d'Ivoire": "Ivory Coast",
    "Kosovo (in accordance with UN Security Council resolution 1244 (1999))": "Kosovo",
    "Micronesia (Federated States of)": "Micronesia",
    "Netherlands (Kingdom of the)": "Netherlands",
    "Lao People's Democratic Republic": "Laos",
    "United States of America": "United States",
    "United Kingdom, England": "United Kingdom",
    "United Kingdom, Northern Ireland": "United Kingdom",
    "United Kingdom, Scotland": "United Kingdom",
    "United Kingdom, Wales": "United Kingdom",
    "United Republic of Tanzania": "Tanzania",
    "Russian Federation": "Russia",
    "Türkiye": "Turkey",
    "Viet Nam": "Vietnam",
    "Bolivia (Plurinational State of)": "Bolivia",
    "Iran (Islamic Republic of)": "Iran",
}

# Folder-style lower-case name -> code, where the plain name table has none.
CODE_OVERRIDES = {
    "bolivia_(plurinational_state_of)": "BO",
    "iran_(islamic_republic_of)": "IR",
    "russian_federation": "RU",
    "united_states_of_america": "US",
    "venezuela_(bolivarian_republic_of)": "VE",
    "viet_nam": "VN",
    "korea_(republic_of)": "KR",
    "democratic_people's_republic_of_korea": "KP",
    "türkiye": "TR",
    "united_kingdom_of_great_britain_and_northern_ireland": "GB",
    "syrian_arab_republic": "SY",
    "republic_of_moldova": "MD",
    "lao_people's_democratic_republic": "LA",
    "micronesia_(federated_states_of)": "FM",
    "united_republic_of_tanzania": "TZ",
    "american_samoa": "AS",
    "czechia": "CZ",
    "côte_d’ivoire": "CI",
    "french_polynesia": "PF",
    "kiribati": "KI",
    "kosovo_(in_accordance_with_un_security_council_resolution_1244_(1999))": "XK",
    "malta": "MT",
    "netherlands_(kingdom_of_the)": "NL",
    "northern_mariana_islands": "MP",
    "north_macedonia": "MK",
    "samoa": "WS",
    "singapore": "SG",
    "tonga": "TO",
    "united_kingdom,_england": "ENG",
    "united_kingdom,_northern_ireland": "NIR",
    "united_kingdom,_scotland": "SCT",
    "wallis_and_futuna": "WF",
}
UK_PARTS = ["ENG", "SCT", "NIR"]

# Ordered land neighbours.
NEIGHBOURS = {
    "Argentina": ["Chile", "Bolivia", "Uruguay", "Paraguay", "Brazil"],
    "Austria": ["Germany", "Italy", "Czech Republic", "Switzerland", "Slovakia", "Hungary"],
    "Belgium": ["France", "Germany", "Netherlands", "Luxembourg"],
    "Bulgaria": ["Romania", "Serbia", "Greece", "Türkiye"],
    "Chile": ["Argentina", "Peru", "Bolivia"],
    "Germany": [
        "France", "Austria", "Belgium", "Netherlands", "Czech Republic",
        "Poland", "Denmark", "Switzerland", "Luxembourg",
    ],
    "Italy": ["France", "Austria", "Switzerland", "Slovenia"],
    "France": ["Belgium", "Germany", "Italy", "Switzerland", "Spain", "Luxembourg"],
    "Spain": ["France", "Portugal"],
    "Netherlands": ["Belgium", "Germany"],
    "Poland": ["Germany", "Czech Republic", "Slovakia", "Ukraine"],
    "Switzerland": ["Germany", "France", "Italy", "Austria"],
    "Czech Republic": ["Germany", "Austria", "Slovakia", "Poland"],
    "Slovakia": ["Czech Republic", "Austria", "Hungary", "Poland"],
    "Hungary": ["Austria", "Slovakia", "Romania", "Serbia"],
    "Romania": ["Hungary", "Bulgaria", "Moldova", "Ukraine"],
    "Greece": ["Bulgaria", "Albania", "North Macedonia"],
    "Portugal": ["Spain"],
    "Denmark": ["Germany"],
    "Sweden": ["Norway", "Finland", "Denmark"],
    "Norway": ["Sweden", "Finland"],
    "Finland": ["Sweden", "Norway"],
    "Serbia": ["Hungary", "Romania", "Bulgaria"],
    "Brazil": ["Argentina", "Uruguay", "Paraguay", "Bolivia"],
    "Bolivia": ["Argentina", "Chile", "Peru", "Brazil", "Paraguay"],
    "Uruguay": ["Argentina", "Brazil"],
    "Paraguay": ["Argentina", "Brazil", "Bolivia"],
    "Peru": ["Chile", "Bolivia", "Brazil"],
}
