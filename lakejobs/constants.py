"""These must stay as they are for results to match."""

# Bounding box as (left longitude, bottom latitude, right longitude, top latitude).
DEFAULT_BBOX = (-122.459696, 47.481002, -122.224433, 47.734136)
# Box of the weather map, longitudes counted 0..360.
MAP_BBOX_360 = (230.0, 20.0, 300.0, 55.0)

# Packed wind field: position of the speed, its divisor, and the missing marks.
WIND_SPEED_INDEX = 3
WIND_SPEED_DIVISOR = 10
WIND_MISSING_TEXT = "9999"
WIND_MISSING_NUMBER = 999.9

# Air quality: country, measure, and the areas left out of the map.
AIR_COUNTRY = "US"
AIR_PARAMETER = "pm25"
EXCLUDED_STATES = ("AK", "HI", "PR", "GU", "VI", "MP", "AS")

# Review tables.
REVIEW_SCHEMA = """
    marketplace string, customer_id string, review_id string, product_id string,
    product_parent string, product_title string, product_category string,
    star_rating int, helpful_votes int, total_votes int, vine string,
    verified_purchase string, review_headline string, review_body string,
    review_date date
"""
# Columns of the range-split tables, and of the sorted and bucketed ones, in the order they are listed.
RANGED_COLUMNS = ("marketplace", "customer_id", "review_id", "product_id", "product_parent", "star_rating")
LAYOUT_COLUMNS = (
    "review_id", "product_id", "customer_id", "product_parent", "star_rating", "helpful_votes",
    "total_votes", "verified_purchase", "marketplace", "product_category", "review_date",
)
KEYWORDS = ("baby", "infant")
TITLE_PREFIX = 45
RATING_DIGITS = 3
SPLIT_WEIGHTS = (0.8, 0.2)
ALS_MAX_ITER = 5
ALS_REG_PARAM = 0.01

# Files of a conversion; large inputs get more.
CONVERTED_FILES = 10

# Gridded weather.
GRID_MEASURES = (
    "air_pressure_at_mean_sea_level",
    "air_temperature_at_2_metres",
    "precipitation_amount_1hour_Accumulation",
)
GRID_STEP_OF_DAY = 12
TEMPERATURE_LEVELS = (-30.0, 5.0, 25)  # first level, step, number of bands
PRESSURE_LEVELS = (900.0, 3.0, 66)
DEFAULT_WEATHER_DAY = "2020-01-13"
