"""The Spark expressions against a plain-Python model on a grid of inputs."""

import itertools
import re

from stratum.functions.cron import schedule_mode, schedule_to_cron

TIMES = [
    "16:00:00", "22, 11:52:38", "Tuesday 11:52:38", "0:30:0", "bad time", None, "25:00:00",
    "Friday   9:05:07", "nan", "", "07:08:60", " 23:59:59", "1:2:3", "01:02:03", "23:59:59 extra",
    "a,b,c", ",12:00:00", "12:00:00,", "Mon\t12:00:00", "Mon \t12:00:00", "24:00:00", "9:60:00",
    "001:00:00", "Wednesday, 5:06:07", "15 ,  3:04:05",
]
FREQS = ["Daily", "weekly", "MONTHLY", "hourly", "yearly", None, "nan", "", "DAILY "]


# Spec of the cron text: s, m, h are integers without zeros.
TEMPLATES = {
    "daily": "{s} {m} {h} * * ? ",
    "monthly": "{s} {m} {h} {p} * ? ",
    "weekly": "{s} {m} {h}  ? * {p3}",
    "hourly": "{s} {m} * * *  ? ",
}
CLOCK = re.compile(r"([01]?[0-9]|2[0-3]):([0-5]?[0-9]):([0-5]?[0-9])")


def spec_cron(text, frequency):
    """Expected cron text for one input pair, from the written spec (None = no cron)."""
    if text is None:
        return None
    if "," in text:
        head, _, rest = text.partition(",")
        prefix, clock = head.strip(), rest.partition(",")[0].strip()
    elif " " in text:
        words = re.sub(r"\s{2,}", " ", text).split(" ")
        prefix, clock = words[0].strip(), words[1].strip()
    else:
        prefix, clock = None, text
    hit = CLOCK.fullmatch(clock)
    if hit is None:
        return None  # a bad time wins over any frequency
    h, m, s = (int(g) for g in hit.groups())
    template = TEMPLATES.get("none" if frequency is None else frequency.lower())
    if template is None:
        return "not yet supported"
    if "{p" in template and prefix is None:
        return None
    return template.format(s=s, m=m, h=h, p=prefix, p3=(prefix or "")[:3])


def test_cron_matches_model_on_grid(spark):
    grid = list(itertools.product(TIMES, FREQS))
    df = spark.createDataFrame(grid, "t string, f string")
    got = df.select("t", "f", schedule_to_cron("t", "f").alias("cron")).collect()
    for r in got:
        assert r.cron == spec_cron(r.t, r.f), (r.t, r.f, r.cron)


def test_cron_examples(spark):
    examples = [
        ("16:00:00", "Daily", "0 0 16 * * ? "),
        ("22, 11:52:38", "monthly", "38 52 11 22 * ? "),
        ("Tuesday 11:52:38", "weekly", "38 52 11  ? * Tue"),
        ("0:30:0", "hourly", "0 30 * * *  ? "),
        ("07:08:60", "daily", None),
        ("16:00:00", "weekly", None),
    ]
    df = spark.createDataFrame(examples, "t string, f string, want string")
    for r in df.select(schedule_to_cron("t", "f").alias("got"), "want").collect():
        assert r.got == r.want


def test_cron_canonical(spark):
    df = spark.createDataFrame([("Tuesday 11:52:38", "weekly"), ("1:2:3", "yearly")], "t string, f string")
    got = [r[0] for r in df.select(schedule_to_cron("t", "f", canonical=True)).collect()]
    assert got == ["38 52 11 ? * Tue", "not yet supported"]


# Both present -> schedule, anything missing (NULL, blank, nan) -> create; the same
# before and after S6 has made what is missing NULL.
MODE_CASES = [
    ("Daily", "16:00:00", "schedule"),
    ("other", "bad", "schedule"),
    *[("Daily", t, "create") for t in (None, "nan", "", " ")],
    *[(f, "16:00:00", "create") for f in (None, "nan", "NaN", "", " ")],
    *[(f, t, "create") for f in (None, "nan", "") for t in (None, "NaN", "")],
]


def test_schedule_mode_case_table(spark):
    df = spark.createDataFrame(MODE_CASES, "f string, t string, want string")
    for r in df.select("f", "t", "want", schedule_mode("f", "t").alias("m")).collect():
        assert r.m == r.want, (r.f, r.t, r.m)
