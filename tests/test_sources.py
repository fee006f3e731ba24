import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from adledger.catalog import load
from adledger.schemas import PENDING, RECORD
from adledger.sources import payload, tables
from adledger.sources.state import Baselines, ConflictError, SearchResults, State
from adledger.sources.tables import as_ads

NOW = dt.datetime(2026, 9, 20)


def test_state_starts_empty_and_publishes_whole_runs(spark, rows, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert state.tracker().count() == 0 and state.latest() is None
    none = rows(PENDING)
    state.write(rows(RECORD, dict(url="a")), none, "r1", NOW)
    state.write(rows(RECORD, dict(url="a"), dict(url="b")), none, "r2", NOW)
    # a replayed run changes nothing, a run without a pointer is not seen
    state.write(rows(RECORD), none, "r2", NOW)
    rows(RECORD, dict(url="x")).write.parquet(str(tmp_path / "state/tracker/run=r3/bucket=0"))
    assert {r.url for r in state.tracker().collect()} == {"a", "b"} and state.latest().seq == 1


def test_decisions_file(spark, tmp_path):
    path = tmp_path / "decisions.md"
    path.write_text("# mine\n- [viewed] https://x/1 — first\nprose https://x/9\n- [] https://x/2\n - [gone]  https://x/1 - last\n", "utf-8")
    got = {r.url: (r.status, r.note) for r in tables.scan_decisions(spark, str(path)).collect()}
    assert got == {"https://x/1": ("GONE", "last"), "https://x/2": ("SEEN", "")}


def test_batches_wrapped_or_bare(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_date": "2026-09-20", "listings": [{"url": "a", "price_pcm": 5}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"url": "b"}, {"url": "c", "bed_count": 2}]))
    got = {r.url: (r.run_date, r.price_pcm, r.bed_count) for r in tables.scan_batch(spark, str(tmp_path)).collect()}
    assert got == {"a": (dt.date(2026, 9, 20), 5, None), "b": (None, None, None), "c": (None, None, 2)}


def test_a_day_is_written_again_without_touching_others(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-02")], "url string, reported_on string")
    tables.write_daily(day, path)
    tables.write_daily(day.where("url = 'b'").withColumn("url", F.lit("c")), path)
    assert {r.url for r in spark.read.parquet(path).collect()} == {"a", "c"}


def test_every_query_has_a_check():
    registered, checks = load()
    assert len(registered) > 140 and set(registered) == set(checks)


def test_wrapped_batches_stay_bounded(spark):
    from adledger.catalog.state_queries import wrapped

    ads = as_ads(spark.range(40_000).selectExpr("id AS ok", "concat('u', id) AS url"))
    got = wrapped(ads, F.floor(F.col("ok") / 400)).selectExpr("count(*) AS n", "sum(size(listings)) AS ads", "max(size(listings)) AS most").first()
    assert (got.n, got.ads, got.most) == (100, 40_000, 400)


def test_a_batch_of_one_url_touches_one_bucket(spark, rows, tmp_path):
    state = State(spark, str(tmp_path / "state"), buckets=16)
    urls = [f"https://x/{i}" for i in range(200)]
    state.write(rows(RECORD, *[dict(url=u, title="old") for u in urls]), rows(PENDING), "r1", NOW)
    before = state.latest().files["tracker"]
    assert len(before) == 16
    part = state.part(spark.createDataFrame([(" https://x/7 ",)], "url string"))
    held = state.tracker(part)
    assert len(part.buckets) == 1 and 0 < held.count() < 40
    assert held.inputFiles() and all(f"bucket={part.buckets[0]}/" in f for f in held.inputFiles())
    state.write(held.withColumn("title", F.lit("new")), rows(PENDING), "r2", NOW, part)
    after = state.latest().files["tracker"]
    assert {b for b in after if after[b] != before[b]} == {str(part.buckets[0])}
    assert state.folder.names("tracker/run=r2")[-1] == f"bucket={part.buckets[0]}"
    titles = {r.url: r.title for r in state.tracker().collect()}
    assert len(titles) == 200 and titles["https://x/7"] == "new" and set(titles.values()) == {"old", "new"}


def test_of_two_runs_from_one_manifest_one_publishes(spark, rows, tmp_path):
    root = str(tmp_path / "state")
    one, two = State(spark, root), State(spark, root)
    a, b = rows(RECORD, dict(url="a")), rows(RECORD, dict(url="b"))
    first, second = one.part(a), two.part(b)
    one.write(a, rows(PENDING), "one", NOW, first)
    with pytest.raises(ConflictError):
        two.write(b, rows(PENDING), "two", NOW, second)
    assert [r.url for r in two.tracker().collect()] == ["a"] and not two.has_run("two")
    two.write(b, rows(PENDING), "two", NOW, two.part(b))
    assert {r.url for r in one.tracker().collect()} == {"a", "b"}
    assert [(r.seq, r.run_id) for r in one.runs().orderBy("seq").collect()] == [(0, "one"), (1, "two")]


def test_an_emptied_bucket_is_gone(spark, rows, tmp_path):
    state = State(spark, str(tmp_path / "state"), buckets=4)
    wait = rows(PENDING, dict(url="a", attempts=1))
    state.write(rows(RECORD), wait, "r1", NOW)
    assert state.pending().count() == 1
    state.write(rows(RECORD, dict(url="a")), rows(PENDING), "r2", NOW, state.part(wait))
    assert state.pending().count() == 0 and state.tracker().count() == 1


def test_a_baseline_is_taken_once_a_day(spark, tmp_path):
    kept = Baselines(spark, str(tmp_path / "base"))
    snap = spark.createDataFrame([(1,)], "tracked long")
    day = dt.date(2026, 9, 20)
    assert kept.newest(day, snap.schema).count() == 0
    assert kept.keep(snap, day) and not kept.keep(spark.createDataFrame([(9,)], "tracked long"), day)
    assert [tuple(r) for r in kept.newest(day + dt.timedelta(3), snap.schema).collect()] == [(1, day)]
    assert kept.newest(day - dt.timedelta(1), snap.schema).count() == 0


def test_results_are_forgotten_with_the_next_run(spark, rows, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    results = SearchResults(state)
    found = spark.createDataFrame([("a", "u1"), ("b", "u2")], "host string, url string")
    told = spark.createDataFrame([("a", "k", True), ("b", "k", True), ("c", "k", True)], "host string, run_key string, clean boolean")
    results.remember(told, found)
    results.remember(told.where("host = 'b'").withColumn("clean", F.lit(False)), found)
    assert {r.host for r in results.manifest().collect()} == {"a", "c"}  # c is clean with no rows
    assert [r.url for r in results.rows(found.schema).collect()] == ["u1"]
    state.write(rows(RECORD), rows(PENDING), "r1", NOW)
    assert results.manifest().count() == results.rows(found.schema).count() == 0


def test_decisions_are_read_in_pieces_and_in_order(spark, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    (path / "1.md").write_text("".join(f"- [early] https://x/{i} - n{i}\n" for i in range(20_000)), "utf-8")
    (path / "2.md").write_text("- [late] https://x/5 - last\n" + "- [seen] https://x/6\r\n- [gone] https://x/6\r\n", "utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = tables.scan_decisions(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
        got = {r.url: (r.status, r.note) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 20_000
    assert got["https://x/5"] == ("LATE", "last") and got["https://x/6"] == ("GONE", "") and got["https://x/7"] == ("EARLY", "n7")


def test_batches_of_lines_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"url": f"u{i}", "title": "x" * 200}) + "\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = tables.scan_batch(spark, str(tmp_path))
        assert df.select("url").distinct().count() == 2000 and df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/b.json").write_text(json.dumps([{"url": "b"}, {"url": "c"}], indent=2))
    assert {r.url for r in tables.scan_batch(spark, str(tmp_path / "b"), lines=False).collect()} == {"b", "c"}


def test_details_are_read_in_one_scan(spark, tmp_path):
    from adledger.sources import details

    page = spark.createDataFrame([("u", "OpenRent", "", "2 bathrooms\n4 tenants max.\n" + "words " * 30 + "\nPrice & Bills\nx")],
                                 "url string, source_name string, html string, text string")
    page.write.parquet(str(tmp_path / "pages"))
    read = details.read_details(spark.read.parquet(str(tmp_path / "pages")), F.lit("2024-01-01").cast("date"))
    assert read._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    [row] = read.collect()
    assert row.bathrooms == 2 and row.parts[0].startswith("Description: words") and row.text.startswith("2 bath")


def search_pages(spark):
    nested = ('<script id="__NEXT_DATA__">{"props":{"pageProps":{"searchResults":{"resultCount":"1,200","properties":[%s]}}}}</script>')
    ad = ('{"displayAddress":"Mill Lane","propertyUrl":"/p/%d#/x","bedrooms":2,"price":{"amount":500,"frequency":"weekly"},'
          '"customer":{"branchDisplayName":"Agent"}}')
    redux = ('<script id="__NEXT_DATA__">{"props":{"initialReduxState":{"results":{"totalResults":"7","list":'
             '[{"details-url":"/d/1","property-title":"Flat","address":"SW3","price":"£1,500 pcm","features":["lift"]}]}}}}</script>')
    pipe = "£900 pcm | 2 beds | 1 bath | Mill Lane, SW3 | Listed today"
    flagged = "£950 | per month | 2 Bed Flat, Mill Lane, SE1| Furnished | Available Now"
    return spark.createDataFrame([
        ("Rightmove", "a", nested % ",".join(ad % i for i in range(3)), None, "x"), ("Rightmove", "b", nested % "", [("h", pipe)], "x"),
        ("Rightmove", "c", None, None, "x"), ("Zoopla", "d", redux, [("/z/1", pipe), ("", pipe), (None, pipe), ("/z/2", None)], "x"),
        ("Zoopla", "e", None, None, "x"), ("Zoopla", "e", None, [], None), ("OnTheMarket", "f", redux, None, "x"), ("OnTheMarket", "f", redux, None, "x"),
        ("OnTheMarket", "g", "<p>blocked</p>", None, "x"), ("OpenRent", "h", None, [("/o/1", flagged), None], "x"),
        ("Other", "i", nested % (ad % 9), [("/i", pipe)], "x"), (None, "j", redux, None, "x")],
        "source_name string, search_url string, html string, cards array<struct<href: string, txt: string>>, url string")


def test_every_search_reader_in_one_scan(spark, as_of):
    pages = search_pages(spark)
    base = "https://b.example"
    got = payload.read_searches(pages, as_of, dict.fromkeys(payload.SEARCHES, base))
    assert got.columns == ["source_name", "search_url", "total", *payload.FACTS]
    assert str(got._jdf.queryExecution().optimizedPlan()).count("Generate explode") == 1
    rows = sorted(map(str, got.collect()))

    def own(name, df):
        df = df.withColumn("source_name", F.lit(name))
        kinds = {f.name: f.dataType for f in got.schema}
        return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in got.columns]).collect()

    keep = ("search_url",)
    of = {n: pages.where(F.col("source_name") == n) for n in payload.SEARCHES}
    cards = {n: df.select("search_url", F.inline("cards")) for n, df in of.items()}
    want = (own("Rightmove", payload.payload_search_nested(of["Rightmove"], base=base, keep=keep))
            + own("Zoopla", payload.card_search_pipe(cards["Zoopla"]))
            + own("OnTheMarket", payload.payload_search_alt_path(of["OnTheMarket"], base=base, keep=keep))
            + own("OpenRent", payload.card_search_flagged(cards["OpenRent"], as_of, base=base)))
    assert rows == sorted(map(str, want)) and len(rows) == 3 + 1 + 1 + 2 + 2 + 1 + 1
    by_url = {r.url: r for r in got.collect()}
    assert by_url[base + "/p/0"].price_pcm == 2167 and by_url[base + "/p/0"].total == 1200
    assert by_url["/z/1"].price_pcm == 900 and by_url[base + "/o/1"].furnished == "Furnished"
    assert payload.read_searches(pages.limit(0), as_of).count() == 0


def test_a_source_can_be_added_to_the_search_registry(spark, as_of):
    pages = search_pages(spark)
    more = payload.SEARCHES | {"Other": payload.Search(payload.pipe_card_facts)}
    got = payload.read_searches(pages, as_of, searches=more).where("source_name = 'Other'").collect()
    assert [(r.url, r.price_pcm, r.platform) for r in got] == [("/i", 900, "Other")]


def test_ads_conditions_go_before_the_shuffle(spark, tmp_path):
    from adledger.catalog.views import VIEWS, Tables
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    odd = lines.limit(20).selectExpr(*[("CASE WHEN l_partkey % 2 = 0 THEN l_orderkey END AS l_orderkey" if c == "l_orderkey" else
                                        "CASE WHEN l_partkey % 2 = 1 THEN l_linenumber END AS l_linenumber" if c == "l_linenumber" else c)
                                       for c in lines.columns])
    lines.unionByName(odd).unionByName(lines.limit(50)).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    want = t.sql(VIEWS["ads"])
    assert t.ads.count() == want.count() and t.ads.select(*want.columns).exceptAll(want).isEmpty()
    plan = t.ads.where("ok % 3 = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "% 3) = 0" in plan.split("Window [", 1)[1]  # the tree is printed from the top


LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def test_orders_meet_line_items_before_ads_are_spelled_out(spark, tmp_path):
    from adledger.catalog.views import VIEWS, Tables

    day = dt.datetime(1998, 1, 1)
    lines = [(k, 10 * (k or 0) + (n or 0), (k or 0) % 5, n, 3.0, 90000.0 + (k or 0), 0.05, 0.07, "R", "O", day) for k in (*range(12), None) for n in (1, 2, 2, None)]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(k, s, day) for k in (*range(10), 3, None) for s in ("F", "O")]  # keys may repeat
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    plain = Tables(spark, str(tmp_path))
    want = plain.sql(VIEWS["tracker"])
    for t in (Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path)).stage("ads")):
        assert t.tracker.schema == want.schema and want.count() > 0
        assert t.tracker.exceptAll(want).isEmpty() and want.exceptAll(t.tracker).isEmpty()
        below = t.tracker._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1]
        assert "https://" not in below


def test_shuffle_files_go_with_their_execution(spark, tmp_path):
    import time

    from adledger.catalog.views import Tables

    Tables(spark, str(tmp_path))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in disk.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in f}

    before = shuffled()
    kept = spark.range(1000).repartition(4, "id")  # a plan that the driver still knows
    kept.write.parquet(str(tmp_path / "out"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 1000 and len(kept.collect()) == len(kept.collect()) == 1000


def test_written_batches_and_decisions_are_compressed(spark, tmp_path, monkeypatch):
    import os

    from adledger.catalog import state_queries
    from adledger.catalog.views import Tables
    monkeypatch.setattr(state_queries, "work_dir", lambda _, name: str(tmp_path / name))
    t = Tables(spark, "/root/testdata/sf0.001")
    assert state_queries.scan_batch(t).count() == state_queries.scan_decisions(t).count() == t.ads.count()
    parts = [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith("part-")]
    assert parts and all(n.endswith(".gz") for n in parts)


def test_pages_are_read_once_to_be_fetched(spark, as_of):
    from adledger.sources import details
    prose = "A bright flat. " * 12
    pages = spark.createDataFrame([
        ("u1", "Rightmove", '<h2>Description</h2><p>Set on the hill.</p></section>', ""),
        ("u2", "Zoopla", "", "top\nProperty description\n" + prose + "\nPoints of interest\nend"),
        ("u3", "OpenRent", "", "1 bathrooms\nshort\nPrice & Bills"), ("u4", "Elsewhere", "", prose),
        ("u5", "OnTheMarket", None, None)], "url string, source_name string, html string, text string")
    got = details.fetched_pages(details.read_details(pages, as_of), F.lit("2024-01-01"))
    assert got.columns == ["url", "fetched_at", "source", "text"]
    assert {r.url: (r.source, r.text) for r in got.collect()} == {
        "u1": ("rightmove-detail", "Description: Set on the hill."), "u2": ("zoopla-detail", "Description: " + prose.strip())}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "regexp" in line]
    assert not [line for line in plan if "RENT" in line.upper() and "PCM" in line.upper()]  # a fact that nobody asks for


def test_plan_texts_are_parsed_once(spark):
    from adledger.operators.plans_read import best_candidate
    texts = spark.createDataFrame([("u", 0, "i", 0.5, "Floor area 500 sqft")], "url string, pos int, image string, score double, ocr_text string")
    best = best_candidate(texts)
    assert [(r.url, r.sqft, r.image) for r in best.collect()] == [("u", 500, "i")]
    plan = best._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("regexp_" in line for line in plan) == 1
