import datetime as dt

from adledger import fixed
from adledger.functions import extract, text

D = dt.date


def test_norm_text_ignores_quotes_dashes_and_spacing(eval_text):
    assert eval_text(text.norm_text, "It’s – “so”\n\tFine ", None) == ["it's - \"so\" fine", ""]


def test_html_to_text_decodes_any_entity_once(eval_text):
    got = eval_text(text.html_to_text, "<p>Caf&eacute; &amp;amp; &#8364;5<br/>x</p>", "no markup", None)
    assert got == ["Café &amp; €5 x", "no markup", None]


def test_monthly_price_prefers_month_then_week(eval_text):
    got = eval_text(extract.monthly_price, "£2,400 | per month", "£500 pw", "£500 pw (£2,167 pcm)",
                    "rent is £1,800 - bills extra, per month", "£1,800 deposit", "from £90 pw")
    assert got == [2400, 2167, 2167, 1800, None, 390]


def test_area_takes_largest_plausible(eval_text):
    got = eval_text(extract.area_sqft, "80 sq ft balcony, 1,010 sq. feet", "120 sq ft", "990 sqft and 400 Sq Ft", None)
    assert got == [1010, None, 990, None]


def test_availability_shapes(eval_text, as_of):
    got = eval_text(
        lambda c: extract.availability(c, as_of),
        "Available from 3 October, 2026", "Availability date: 1st Dec 2026 Furnished",
        "Let available date: 05/11/2026 Deposit", "Available now", "Available to move in from March 2027",
        "Available from 30th August", "Available 2 January", "parking available at cost. Available immediately",
        "phone lines available 9am", "Available from 31 February 2027", "Available from Sept 2026",
        "unavailable from 3 May 2027")
    assert got == [D(2026, 10, 3), D(2026, 12, 1), D(2026, 11, 5), D(2026, 9, 20), D(2027, 3, 1),
                   D(2026, 8, 30), D(2027, 1, 2), D(2026, 9, 20), None, None, None, D(2027, 5, 3)]


def test_leap_day_without_a_year_needs_a_leap_year(eval_text, spark):
    from pyspark.sql import functions as F
    ask = "Available from 29 February"
    assert eval_text(lambda c: extract.availability(c, F.lit(D(2026, 12, 1))), ask) == [None]
    assert eval_text(lambda c: extract.availability(c, F.lit(D(2027, 12, 1))), ask) == [D(2028, 2, 29)]


def test_parse_date_spellings(eval_text):
    got = eval_text(extract.parse_date, "2026-03-04", "4 March 2026", "04 mar 2026", "4/3/2026",
                    "4 Smarch 2026", "31/11/2026", "", None)
    assert got == [D(2026, 3, 4)] * 4 + [None] * 4


def test_district_and_stem(spark, eval_text):
    from pyspark.sql import functions as F
    got = eval_text(lambda c: extract.district(c), "Sloane St, London sw1x 9aa", "Richmond", "N1C", None)
    assert got == ["SW1X", None, "N1C", None]
    assert eval_text(extract.district_stem, "SW1X", "SW1", None) == ["SW1", None, None]
    assert eval_text(lambda c: extract.district(F.lit("Mill Lane"), c), "Mill Lane SE5") == ["SE5"]


def test_addr_key_drops_postcode_but_not_ordinals(eval_text):
    from pyspark.sql import functions as F
    got = eval_text(lambda c: extract.addr_key(c, F.lit(None).cast("string")),
                    "1st Floor, The Mill, London E1W 2AB", "The Mill, E1W", "2ab Mill", "E1W 2AB 3CD Mill",
                    "Greater London, UK", "x" * 60)
    assert got == ["1st floor mill", "mill", "2ab mill", "3cd mill", "", "x" * 40]


def test_amenities(eval_text):
    a, b, c, d, e = eval_text(
        extract.amenities,
        "Set on the ninth floor with lift, concierge. Newly renovated, 1,100 sq ft",
        "Concierge on the ground floor. No lift. Scope for modernisation",
        "Garden level flat", "Key features: Gym / New Build / Balcony\n2nd floor",
        "Floorplan area: 900 sq ft (total)\nabout 640 sq ft. On the upper floor. A third-floor flat")
    assert (a.floor_number, a.lift, a.concierge, a.condition, a.size_sqft) == (9, "yes", "yes", "refurbished", 1100)
    assert (b.floor_level, b.lift, b.condition) == ("ground", "no", "needs_work")
    assert c.floor_level == "lower_ground"
    assert (d.condition, d.floor_number) == ("new_build", 2)
    assert (e.size_sqft, e.floor_number) == (640, 3)


def test_furnishing(eval_text):
    from pyspark.sql import functions as F
    assert eval_text(extract.furnishing_in_text, "comes PART FURNISHED", "unfurnished or furnished", "bare") == [
        "Part furnished", "Furnished or unfurnished", None]
    got = eval_text(lambda c: extract.furnishing_of(c, F.lit("furnished")),
                    "Furnished or Unfurnished", "Part", "no", "Yes", "Ask agent", None)
    assert got == ["furnished", "part furnished", "unfurnished", "furnished", None, None]
    assert eval_text(extract.furnishing_label, "either or unfurnished", "partly", "x") == ["either", "part", None]


def test_plan_area_prefers_total_then_gross_then_feet(eval_text):
    got = eval_text(
        extract.parse_area,
        "Gross internal area 70 sq m / 750 sq ft Terrace 40 sq ft Total = 790 sq ft",
        "Approximate area 80 Sq. metres 861 Sq.feet", "Internal area 50 sqm", "812 sq ft",
        "Kitchen 140 sq ft Lounge 260 sq ft", "9 sq ft", "no area", None)
    assert [(r.sqft, r.basis, r.confident) for r in got] == [
        (790, "total", True), (861, "gross", True), (538, "gross/converted", True), (812, "stated", True),
        (260, "stated", False), (None, "", False), (None, "", False), (None, "", False)]
    assert got[3].evidence == "812 sq ft"


def test_plan_label_must_be_near(eval_text):
    far = "Total floor plan drawn for illustration only and not to any scale whatsoever, see notes " + "x" * 20 + " 700 sq ft"
    assert eval_text(extract.parse_area, far)[0].basis == "stated"


def test_plan_floors(eval_text):
    assert eval_text(extract.plan_floors, "Second  Floor, second floor, 3rd Floor") == [["second", "3rd"]]
    got = eval_text(lambda c: extract.floor_from_plan(extract.plan_floors(c)),
                    "Ground Floor and Basement floor", "upper ground floor", "Tenth floor", "first floor second floor", "none")
    assert [(r.floor_level, r.floor_number) for r in got] == [
        ("lower_ground", None), ("ground", None), (None, 10), (None, None), (None, None)]
    assert eval_text(extract.is_plan_text, "12'3 x 9'1", "(3.20) first floor", "(3.20)", None) == [True, True, False, False]


def test_slice_between_stops_only_at_line_start_headings(eval_text):
    page = "Menu\nDescription\nA home in a good location near shops\n  and parks.\nLocation\nMap"
    got = eval_text(lambda c: text.slice_between(c, ["Description"], ["Location"], 10), page, "Menu")
    assert got == ["A home in a good location near shops and parks.", ""]
    assert eval_text(lambda c: text.slice_between(c, ["Menu", "Description"], ["Description", "Location"], 20), page)[
        0].startswith("A home")


def test_labels_and_sizes_in_payloads(eval_text):
    got = eval_text(lambda c: extract.fact_labels(c, fixed.LETTING_BLOCK, fixed.LETTING_ITEM),
                    '"lettingDetails":{"items":["Available &amp; ready"," ","Furnished"]}', "none")
    assert got == [["Available & ready", "Furnished"], []]
    got = eval_text(lambda c: extract.size_from_payload(c, fixed.SIZE_KEY_DIRECT, fixed.SIZE_KEY_NESTED),
                    r'\"sizeSqFeet\":\"840\"', '"sizeSqFeet":"","floorArea":{"u":"x","value":702.9}', '"sizeSqFeet":"50"')
    assert got == [840, 702, None]


def test_challenge_is_read_in_head_and_title(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("<title>Just a Moment...</title>", "hi"), ("", "x" * 4000 + "captcha"), (None, "CAPTCHA")],
                               "h string, b string")
    got = [r[0] for r in df.select(text.challenged(F.col("h"), F.col("b"))).collect()]
    assert got == [True, False, True]
