import datetime as dt
import random

from pyspark.sql import functions as F

from adledger.functions import terms
from adledger.operators import quality, search, verdicts
from adledger.schemas import FLAT_VERDICT, PAGE

DAY = dt.date(2026, 9, 20)


def slices(text, words, pad, gap):
    """The window rule, one occurrence at a time."""
    low = text.lower()
    spans = sorted((max(0, i - pad), min(len(text), i + len(w) + pad))
                   for w in words for i in range(len(low)) if low.startswith(w, i))
    if not spans:
        return text
    out = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return gap.join(text[a:b] for a, b in out)


def test_windows_match_brute_force(spark):
    rnd = random.Random(5)
    words = ("vrv", "air con", "aircon", "a/c", "air")
    texts = ["", "nothing here", "VRVRV", "aircon"] + [
        "".join(rnd.choice(["vrv", "rv", "air con", "AIRcon", "a/c", "é", " ", "xxxx", "zzzzzzzz", "\n"]) for _ in range(40))
        for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.windows for r in terms.context_windows(df, terms=words, pad=4, gap="|~|").collect()}
    assert [got[i] for i in range(len(texts))] == [slices(x, words, 4, "|~|") for x in texts]


def test_claims_need_their_quote(rows):
    pages = rows(PAGE, dict(url="p", fetched_at=DAY, text="We have “air conditioning” – throughout."), dict(url="empty", text=None))
    claims = [("ok", "Yes", "in_unit", '"AIR  conditioning" - through'), ("ok2", "likely", "lobby", "we have"), ("ok3", "no", "in_unit", "throughout"),
              ("gone", "yes", "in_unit", "chilled"), ("blank", "yes", "in_unit", " "), ("word", "perhaps", "in_unit", "we"),
              ("quiet", "unstated", "", "")]
    # one page per claim, same text
    many = pages.where("url = 'p'").crossJoin(F.broadcast(rows(FLAT_VERDICT, *[dict(url=u) for u, *_ in claims]).select(F.col("url").alias("u")))
                                              ).withColumn("url", F.col("u")).drop("u").unionByName(pages)
    v = rows(FLAT_VERDICT, *[dict(url=u, verdict=a, scope=b, evidence=c) for u, a, b, c in claims],
             dict(url="empty", verdict="yes", evidence="x"), dict(url="nowhere", verdict="yes", evidence="x"))
    got = {r.url: (r.verdict, r.scope, len(r.flags)) for r in verdicts.validate_verdicts(v, many).collect()}
    assert got == {"ok": ("yes", "in_unit", 0), "ok2": ("likely", "unclear", 1), "ok3": ("no", "", 0), "gone": ("unstated", "", 1),
                   "blank": ("unstated", "", 1), "word": ("unstated", "", 1), "quiet": ("unstated", "", 0),
                   "empty": ("unchecked", "", 1), "nowhere": ("unchecked", "", 1)}


def test_carried_only_while_the_page_stands(rows, spark):
    pages = rows(PAGE, dict(url="a", text="Has aircon"), dict(url="b", text="now silent"), dict(url="c", text="aircon new"))
    stamped = verdicts.stamp_verdicts(rows(FLAT_VERDICT, dict(url="a", verdict="yes", evidence="aircon"), dict(url="zz", verdict="no")), pages)
    assert {r.url: bool(r.text_sha) for r in stamped.collect()} == {"a": True, "zz": False}
    spaced = rows(PAGE, dict(url="a", text="has   AIRCON"), dict(url="c", text="aircon new"), dict(url="d", text="aircon"), dict(url="e", text="plain"))
    store = stamped.unionByName(rows(FLAT_VERDICT, dict(url="c", verdict="yes", evidence="old words")))
    got = {r["url"]: (r["class"], r["rejudge"]) for r in verdicts.rejudge_partition(spaced, store).collect()}
    assert got == {"a": ("carried", False), "c": ("review", True), "d": ("review", False), "e": ("silent", False)}


def test_upper_median_is_exact(spark):
    rnd = random.Random(3)
    data = [(k, rnd.randrange(50)) for k in "abc" for _ in range(rnd.randrange(1, 40))] + [("one", 7)]
    got = {r.k: r["median"] for r in quality.upper_median(spark.createDataFrame(data, "k string, v int"), "k", "v").collect()}
    for k in got:
        values = sorted(v for kk, v in data if kk == k)
        assert got[k] == values[len(values) // 2]


def test_no_pages_is_ready_and_unsampled_is_not(spark):
    ads = spark.createDataFrame([("A",), ("B",)], "platform string")
    health = spark.createDataFrame([("A", True)], "source string, ok boolean")
    assert quality.readiness(ads, health.where("false")).first().ready
    row = quality.readiness(ads, health).first()
    assert (row.never_sampled, row.ready) == (1, False)


def test_windows_snap_up_and_empty_pages(spark):
    urls = spark.createDataFrame([("https://zoopla.co.uk/a?x=1", 2), ("https://zoopla.co.uk/a", None), ("https://zoopla.co.uk/a?added=3_days", 1),
                                  ("https://rightmove.co.uk/a?x", 40), ("https://other.example/", 1)], "url string, gap int")
    got = [(r.scoped_url, r.window_days) for r in search.recency_window(urls, F.col("gap"), 14).collect()]
    assert got == [("https://zoopla.co.uk/a?x=1&added=7_days", 7), ("https://zoopla.co.uk/a?added=14_days", 14),
                   ("https://zoopla.co.uk/a?added=3_days", None), ("https://rightmove.co.uk/a?x", None), ("https://other.example/", None)]
    pages = spark.createDataFrame([(1, 0, "", "https://zoopla.co.uk/s"), (0, 0, "3,075 results", "https://onthemarket.com/s"),
                                   (0, 0, "0 results", "https://rightmove.co.uk/s?maxDaysSinceAdded=3"), (0, 0, "", "https://rightmove.co.uk/s"),
                                   (0, None, "", "https://rightmove.co.uk/s?maxDaysSinceAdded=3"), (0, 0, "0 results found", "https://zoopla.co.uk/s?added=3_days")],
                                  "page_no int, total int, text string, url string")
    got = [r[0] for r in pages.select(search.empty_status(F.col("page_no"), F.col("total"), F.col("text"), F.col("url"))).collect()]
    assert got == ["ok", "missed", "quiet", "empty", "empty", "empty"]
