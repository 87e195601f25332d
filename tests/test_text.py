import random

import pytest
from pyspark.sql import functions as F

from gridhaul.functions import constants as C
from gridhaul.functions import geo, keys
from gridhaul.functions import text as X
from gridhaul.functions.register import register


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def drawn(seed, n, words):
    """Texts of random words, marks and blanks."""
    rng = random.Random(seed)
    marks = [" ", " ", "  ", ", ", ". ", "; ", "\t", "-", "/", "#"]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(7))) for _ in range(n)]


def test_queries_are_normalised_word_by_word(spark):
    words = [*C.SUFFIX, *C.LONG_DIRECTION, "BIRCH", "Ünter", "7b", "22", "x"]
    given = drawn(1, 200, [f(w) for w in words for f in (str.lower, str.title)]) + ["\u00a0", "ß", "."]

    def plain(text):
        kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in text.lower()).split()
        return " ".join(C.SUFFIX.get(t, C.LONG_DIRECTION.get(t, t)) for t in kept)

    assert values(spark, X.normalize_query, given) == [plain(t) for t in given]


def test_house_numbers_by_first_and_remaining_words(spark):
    """A number may carry a letter and a second such number; five digits before nothing but short words and numbers are a postal code."""
    firsts = {"7": True, "007": True, "7c": True, "7c-9": True, "7-9d": True, "c7": False, "7cc": False, "7-": False, "-7": False, "7-9-11": False, "": False, "48226": None, "48226x": True, "482261": True}
    rests = {"": None, "mi": False, "mi us": False, "9": False, "mi 12345678": False, "birch": True, "mi birch": True, "abc": True}
    cases = [(f"{a} {b}".strip(" ") if b else a, ok, long) for a, ok in firsts.items() for b, long in rests.items()]
    want = [long is not None and bool(long if ok is None else ok) for _, ok, long in cases]
    given = [t for t, _, _ in cases]
    starts_elsewhere = [k for k, (t, _, _) in enumerate(cases) if not t or t.split(" ")[0] not in firsts]  # an empty first word lets the next one lead
    assert [x for k, x in enumerate(values(spark, X.has_house_number, given)) if k not in starts_elsewhere] == [x for k, x in enumerate(want) if k not in starts_elsewhere]
    many = "6 " * 1500
    assert values(spark, X.has_house_number, [many + "birch", "48226 " + many + "6", "48226 " + many + "birch"]) == [True, False, True]


def test_number_and_street_of_an_address(spark):
    built = [(f"{pad}{n}{gap}{street}{end}", n, street, code) for pad in ("", "   ") for n in (1, 58, 90817) for gap in (" ", "   ") for street in ("birch hollow", "0th alley", "l'anse") for end, code in (("", None), (", Marlow", None), (" 48226", "48226"), (", MI 48226-0001", "48226"), (", 12345, 67890", "67890"))]
    found = values(spark, X.parse_address, [t for t, *_ in built])
    kept = lambda street: " ".join(C.SUFFIX.get(w, C.LONG_DIRECTION.get(w, w)) for w in street.split())
    wrong = [(t, f) for (t, n, street, code), f in zip(built, found, strict=True) if f is None or (f.number, f.street) != (n, kept(street)) or n != 90817 and f.zip != code]
    assert not wrong
    assert values(spark, X.parse_address, ["0 birch", "birch 5", "5", "5b birch", "5 ,birch", "5 ., x", "", "-5 birch"]) == [None] * 8


def test_states_by_code_name_and_postal_code(spark):
    """The last code wins over names, a name over postal codes, the first postal code's range is what remains."""
    codes, names = list(C.STATE_CODES), list(C.STATE_NAMES)
    given = [f"x {a} y, {b}" for a, b in zip(codes, codes[1:], strict=False)] + [f"{n.title()} {a.lower()}" for n, a in zip(names, reversed(codes), strict=False)]
    want = codes[1 : len(codes)] + [a for _, a in zip(names, reversed(codes), strict=False)]
    given += [f"q{n.upper()}q" for n in names]
    want += [next(C.STATE_NAMES[m] for m in names if m in n) for n in names]
    edges = [(p, s) for a, z, s in C.ZIP3 for p in (a, z)]
    given += [f"q {p:03d}99 99999" for p, _ in edges]
    want += [next(s for a, z, s in C.ZIP3 if a <= p <= z) for p, _ in edges]
    given += ["", "q", "QQ zz", "1234 123456"]
    want += [None] * 4
    assert values(spark, X.parse_state, given) == want


def test_lists_speeds_numbers_and_points(spark):
    lists = drawn(2, 60, ["p", "q r", "|", " |", "| ", "||"])
    assert values(spark, X.split_multi, lists) == [[part.strip(" ") for part in t.split("|") if part.strip(" ")] for t in lists]
    speeds = {"65 mph": 65 * 1.60934, "65mph": 65 * 1.60934, "7.5": 7.5, "110 km/h": 110.0, "walk": None, "65 knots": None, "mph": None, " ": None}
    assert values(spark, X.parse_maxspeed, list(speeds)) == [x if x is None else pytest.approx(x) for x in speeds.values()]
    assert values(spark, X.leading_int, ["88-Q", " 88", "Q88", "88.5", "", "-88"]) == [88, 88, None, 88, None, None]
    points = {"-8.25,140": (-8.25, 140.0), " 8 , -140.5 ": (8.0, -140.5), "8;140": None, "8,": None, ",140": None, "8,140,3": None, "1e2,3": None}
    assert [x and tuple(x) for x in values(spark, X.coordinate, list(points))] == list(points.values())
    df = spark.createDataFrame([(None, 1.0), ("", 1.0), ("a", 1.0)], "t string, x double").select(X.row_key(F.col("t"), F.col("x")).alias("k"))
    a, b, c = (r.k for r in df.collect())
    assert a == b != c


def test_formats(spark):
    km = values(spark, lambda c: geo.format_distance(c, "metric"), [999.0, 1500.0, 12345.0, 6050.0, 6250.0, 12500.0], "double")
    assert km == ["999 m", "1.5 km", "12 km", "6.0 km", "6.3 km", "13 km"]
    assert values(spark, geo.format_distance, [100.0, 8690.0, 20000.0], "double") == ["328 ft", "5.4 mi", "12 mi"]
    assert values(spark, geo.format_duration, [0.0, 45.0, 60.0, 660.0, 3600.0, 3660.0, 7320.0], "double") == ["1 sec", "45 secs", "1 min", "11 mins", "1 hour", "1 hour 1 min", "2 hours 2 mins"]
    assert values(spark, geo.quantise, [0.2, 2.5, 3.5, 1e9], "double") == [1, 2, 4, 65535]
    assert values(spark, geo.plain_number, [40.758, 37.0, -122.5], "double") == ["40.758", "37", "-122.5"]


def test_tiles(spark):
    df = spark.createDataFrame([(-122.0, 37.0), (-180.0, -90.0), (0.1, 0.1)], "lon double, lat double")
    packed = geo.pack_tile(geo.tile_x(F.col("lon")) - 700, geo.tile_y(F.col("lat")))
    tx, ty = geo.unpack_tile(F.col("p"))
    rows = df.withColumn("p", packed).select((geo.tile_x(F.col("lon")) - 700).alias("a"), geo.tile_y(F.col("lat")).alias("b"), tx.alias("c"), ty.alias("d")).collect()
    assert all((r.a, r.b) == (r.c, r.d) for r in rows)


def test_keys_and_shown_values(spark):
    assert values(spark, keys.byte_size, [0, 900, 1536, 5 << 30], "long") == ["0.0 B", "900.0 B", "1.5 KB", "5.0 GB"]
    assert values(spark, keys.minutes, [None, 0.0, 89.0, 3600.0], "double") == ["—", "—", "1", "60"]
    assert values(spark, keys.percent, [None, 0.0, -3.25, 12.0], "double") == ["—", "+0.0%", "-3.3%", "+12.0%"]
    assert values(spark, keys.thousands, [1234567], "long") == ["1,234,567"]
    assert values(spark, lambda c: keys.source_parts(c)[1], ["us/tx/" + "/".join(str(k) for k in range(150))]) == ["-".join(str(k) for k in range(150))]
    assert values(spark, X.strict_coordinate, ["1.5,-2", "1.5, -2", "1234,5", "x"]) == [True, False, False, False]
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(keys.capped_list(F.col("x"), 2)).collect()] == ["a b (+1 more)", "-", "-"]


def test_sql_table_function(spark):
    register(spark)
    rows = spark.sql("SELECT * FROM route_matrix('37.0,-122.0|x', '37.0,-122.0|38.0,-122.0')").collect()
    assert [(r.origin, r.dest, r.metres and round(r.metres)) for r in rows] == [(0, 0, 0.0), (0, 1, 111195), (1, 0, None), (1, 1, None)]
