"""Values that results depend on."""

from __future__ import annotations

# Geometry, grids and limits.
EARTH_M = 6_371_000.0
CELL_DEG = 0.25
SNAP_CELLS = 25
SNAP_K = 5
SNAP_SEPARATION_M = 200.0
L1_CELL_DEG = 0.1
L1_MAX_RING = 10
HEURISTIC_M_S = 30.0
L0_MAX_KM = 500.0
MPH = 1.60934
METRES_A_MILE = 1609.344
FEET_A_METRE = 3.28084
MAX_ELEMENTS, PER_SECOND, PER_DAY, GLOBAL_PER_DAY = 25, 5, 2_500, 25_000
KEY_RATIO, CHURN, SHRINK = 0.95, 0.5, 0.10
ID_BLOCK = 1 << 40
ROWS_PER_STATEMENT = 250

# Street suffixes and directions with their postal abbreviations.
LONG_SUFFIX = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "terrace": "ter",
    "trail": "trl", "parkway": "pkwy", "highway": "hwy", "circle": "cir", "square": "sq", "way": "way", "alley": "aly", "plaza": "plz",
}
LONG_DIRECTION = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
SUFFIX = LONG_SUFFIX | {"str": "st"} | {v: v for v in LONG_SUFFIX.values() if v != "st"}
DIRECTION = LONG_DIRECTION | {v: v for v in LONG_DIRECTION.values()}

# Patterns of addresses, postal codes, state codes, points and speed tags.
HOUSE_PATTERN = r"^[0-9]+[a-z]?(-[0-9]+[a-z]?)?$"
ADDRESS_PATTERN = r"^\s*(\d+)\b\s+([^,]+?)(?:,|\s+\d{5}|$)"
ZIP_PATTERN = r"\b(\d{5})(?:-\d{4})?\b"
STATE_CODE_PATTERN = r"(?:^|[\s,])([A-Z]{2})(?=[\s,]|\d|$)"
POINT_PATTERN = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
STRICT_POINT_PATTERN = r"^-?\d{1,3}(\.\d+)?,-?\d{1,3}(\.\d+)?$"
MPH_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*mph\s*$"
SPEED_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(?:mph|km/?h)?\s*$"  # either of the two
KMH_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(?:km/?h)?\s*$"

# Road classes with free-flow speeds in km/h.
SPEED_KMH = {
    "motorway": 105, "trunk": 90, "primary": 65, "secondary": 55, "tertiary": 45, "residential": 30, "service": 20, "unclassified": 40,
    "motorway_link": 60, "trunk_link": 50, "primary_link": 45, "secondary_link": 40, "tertiary_link": 35, "living_street": 15, "road": 40,
}
DEFAULT_KMH = 40
L1_CLASSES = ("motorway", "motorway_link")

# States by name, in the order in which names are looked for.
STATE_NAMES = {
    "alabama": "AL", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "washington_dc": "DC",
    "florida": "FL", "georgia": "GA", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
STATE_CODES = sorted(set(STATE_NAMES.values()))
# The order in which shards are asked when the state is unknown.
SHARD_ORDER = "AL AZ AR CA CO CT DE DC FL GA ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
# First three digits of postal codes, by ranges.
ZIP3 = (
    (10, 27, "MA"), (28, 29, "RI"), (30, 33, "NH"), (34, 34, "ME"), (35, 38, "NH"), (39, 49, "ME"), (50, 59, "VT"), (60, 69, "CT"), (70, 89, "NJ"), (100, 149, "NY"), (150, 196, "PA"), (197, 199, "DE"),
    (200, 205, "DC"), (206, 219, "MD"), (220, 246, "VA"), (247, 268, "WV"), (270, 289, "NC"), (290, 299, "SC"), (300, 319, "GA"), (320, 349, "FL"), (350, 369, "AL"), (370, 385, "TN"), (386, 397, "MS"), (398, 399, "GA"),
    (400, 427, "KY"), (430, 459, "OH"), (460, 479, "IN"), (480, 499, "MI"), (500, 528, "IA"), (530, 549, "WI"), (550, 567, "MN"), (570, 577, "SD"), (580, 588, "ND"), (590, 599, "MT"), (600, 629, "IL"), (630, 658, "MO"),
    (660, 679, "KS"), (680, 693, "NE"), (700, 714, "LA"), (716, 729, "AR"), (730, 749, "OK"), (750, 799, "TX"), (800, 816, "CO"), (820, 831, "WY"), (832, 838, "ID"), (840, 847, "UT"), (850, 865, "AZ"), (870, 884, "NM"),
    (889, 898, "NV"), (900, 961, "CA"), (970, 979, "OR"), (980, 994, "WA"),
)
