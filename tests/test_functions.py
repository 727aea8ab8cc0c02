import datetime as dt

from pyspark.sql import functions as F

from postlake.functions import scalars
from postlake.functions.stem import with_stem
from postlake.functions.analyze import STOP_WORDS
from postlake.operators import requestlog
from postlake.operators.listing import page_params


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_page_params():
    got = [page_params(*a) for a in [(0, 0), (3, 50), (2, 101), ("x", "y"), (None, None), (-1, 100)]]
    assert [(p.page, p.page_size, p.offset) for p in got] == [
        (1, 20, 0), (3, 50, 100), (2, 20, 20), (1, 20, 0), (1, 20, 0), (1, 100, 0)
    ]


def test_days():
    assert scalars.day_or_none("2024-02-29") == dt.datetime(2024, 2, 29)
    for bad in ("2024-2-1", "2023-02-29", "x", "", None, "2024-01-01 ", "20240101"):
        assert scalars.day_or_none(bad) is None


def test_extract_id(spark):
    rows = [
        ("https://x/job/12", r"/job/(\d+)", "12"),
        ("https://x/job/a", r"/job/(\d+)", ""),
        ("https://x/job/12", r"/job/\d+", ""),
        ("https://x/job/12", r"/job/(?:\d+)", ""),
        ("https://x/job(12", r"/job\((\d+)", "12"),
        ("https://x/job(12", r"/job\(\d+", ""),
        ("https://x/job/12", r"/job/(?P<n>\d+)", "12"),
        ("https://x/job/12", r"[(]", ""),
        ("https://x/job/12", None, ""),
        ("https://x/job/", r"/job/(\d+)?", ""),
    ]
    df = spark.createDataFrame(rows, "u string, p string, want string")
    for got, want in df.select(scalars.extract_id("u", "p"), "want").collect():
        assert got == want


def test_scalars(spark):
    row = one(
        spark,
        scalars.trim_ws(F.lit(" \t a b　\n\u0085")),
        scalars.url_from_template(F.lit("a/{id}/{id}"), F.lit("7")),
        scalars.url_from_template(F.lit(None).cast("string"), F.lit("7")),
        scalars.num_to_id(F.lit(-3.9)),
        scalars.classify_error(F.lit("received non-OK status code: 404")),
        scalars.classify_error(F.lit("received non-OK status code: 500")),
        scalars.classify_error(F.lit(None).cast("string")),
    )
    assert list(row) == ["a b", "a/7/7", "", "-3", "final", "retry", None]


def test_age_label(spark):
    now = dt.datetime(2024, 6, 1, 12)
    cases = {
        0: "0 days ago",
        3600: "yesterday",
        86400: "yesterday",
        86401: "2 days ago",
        6 * 86400: "6 days ago",
        7 * 86400: "1 weeks ago",
        29 * 86400: "5 weeks ago",
        30 * 86400: "1 months ago",
        364 * 86400: "13 months ago",
        365 * 86400: "2023-06-02",
    }
    rows = [(now - dt.timedelta(seconds=s), want) for s, want in cases.items()]
    rows.append((now + dt.timedelta(hours=30), "2 days ago"))
    df = spark.createDataFrame(rows, "t timestamp_ntz, want string")
    for got, want in df.select(scalars.age_label("t", scalars.ntz(now)), "want").collect():
        assert got == want


STEMS = {
    "running": "run", "engineers": "engin", "happily": "happili", "hoped": "hope", "hopping": "hop",
    "generalization": "general", "national": "nation", "caresses": "caress", "ponies": "poni", "ties": "tie",
    "cats": "cat", "gas": "gas", "kiwis": "kiwi", "agreed": "agre", "bled": "bled", "motoring": "motor",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "falling": "fall", "happy": "happi",
    "say": "say", "by": "by", "dying": "die", "skies": "sky", "news": "news", "consignment": "consign",
    "knackeries": "knackeri", "kneel": "kneel", "communication": "communic", "communism": "communism",
    "arsenal": "arsenal", "generously": "generous", "inning": "inning", "exceedingly": "exceed",
    "university": "univers", "sensational": "sensat", "hopefulness": "hope", "triplicate": "triplic",
    "electricity": "electr", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "cease": "ceas",
    "controll": "control", "roll": "roll", "analogously": "analog", "used": "use", "yelled": "yell",
    "youth": "youth", "boyish": "boyish", "flying": "fli", "beautiful": "beauti", "luxuriated": "luxuri",
    "fluently": "fluentli", "abilities": "abil", "sayyid": "sayyid", "é": "é", "développement": "développ",
}


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "word string, want string")
    wrong = [r for r in with_stem(df, "word", "stem").collect() if r["stem"] != r["want"]]
    assert wrong == []


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127


def test_request_log(spark):
    headers = F.create_map(*[F.lit(x) for x in ("COOKIE", "c", "x-Api-Key", "k", "Accept", "a", "X-Real-IP", "9.9.9.9")])
    row = one(
        spark,
        requestlog.redact(headers),
        requestlog.client_ip(headers, F.lit("r")),
        requestlog.client_ip(F.create_map(F.lit("x-forwarded-for"), F.lit("1.1.1.1, 2.2.2.2")), F.lit("r")),
        requestlog.client_ip(F.create_map(F.lit("X-Forwarded-For"), F.lit("")), F.lit("r")),
        requestlog.logged_request_body(F.lit("POST"), F.lit("é" * 1025)),
        requestlog.logged_request_body(F.lit("GET"), F.lit("x")),
        requestlog.logged_response_body(F.lit(200), F.lit("/api/x"), F.lit("y" * 1024)),
        requestlog.logged_response_body(F.lit(200), F.lit("/web"), F.lit("y")),
        requestlog.level(F.lit(499)),
    )
    assert list(row) == [
        {"Accept": "a", "X-Real-IP": "9.9.9.9"}, "9.9.9.9", "1.1.1.1", "r",
        "[Request body too large: 2050 bytes]", "", "y" * 1024, "", "warn",
    ]


def test_numbers_beyond_an_id(spark):
    df = spark.createDataFrame([(1e30,), (12.9,), (-3.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.num_to_id("x")).collect()] == [None, "12", "-3", None]
