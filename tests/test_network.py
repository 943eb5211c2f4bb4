"""Network and register evidence on odd rows."""

from pyspark.sql import functions as F

from evidentia.operators import evidence, latest


def test_last_spf_record_wins(spark):
    rows = [("a", "TXT", "v=spf1 z", 1), ("a", "TXT", "v=spf1 a", 2), ("a", "TXT", "iets", 3), ("b", "DMARC", "geen", 1), ("b", None, None, None)]
    answers = spark.createDataFrame(rows, "domain string, rtype string, value string, place int")
    found = {r.domain: (r.spf_record, r.dmarc_record, r.has_spf, r.has_dmarc) for r in evidence.dns_summary(answers).collect()}
    assert found == {"a": ("v=spf1 a", None, True, False), "b": (None, None, False, False)}
    without = {r.domain: r.spf_record for r in evidence.dns_summary(answers.drop("place")).collect()}
    assert without["a"] == "v=spf1 z"


def test_certificates_without_issuer_or_dates(spark):
    schema = "id int, issuer array<struct<k:string,v:string>>, subject array<struct<k:string,v:string>>, not_before string, not_after string, san array<struct<kind:string,value:string>>"
    name = [("commonName", "a")]
    rows = spark.createDataFrame([(1, None, None, None, None, None), (2, name, name, "x", None, []), (3, [], name, None, "20250601120000Z", None)], schema)
    found = {r.id: r for r in evidence.certificate_record(rows, F.lit("2025-06-02 11:00:00").cast("timestamp")).collect()}
    assert not found[1].has_ssl and found[1].is_expired is None
    assert found[2].has_ssl and found[2].is_self_signed and found[2].valid_until is None and found[2].san_domains == []
    assert found[3].issuer_name is None and found[3].is_expired and found[3].days_until_expiry == -1


def test_network_record_keeps_shops_of_one_check(spark):
    one = lambda name, rows: spark.createDataFrame(rows, f"shop int, {name} int")
    found = evidence.network_record(one("a", [(1, 1)]), one("b", [(2, 2)]), one("c", [(1, 3), (3, 3)]), "shop").orderBy("shop").collect()
    assert [(r.shop, r.dns is not None, r.headers is not None, r.redirects is not None) for r in found] == [(1, True, False, True), (2, False, True, False), (3, False, False, True)]


def test_register_cascade_and_dates(spark):
    numbers = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "number int")
    first = spark.createDataFrame([(1, "b", False), (1, "a", None), (2, "", True), (None, "x", True)], "number int, company_name string, is_active boolean")
    second = spark.createDataFrame([(1, "z", True), (2, "y", True)], "number int, company_name string, is_active boolean")
    found = {r.number: (r.company_name, r.is_active, r.source) for r in evidence.register_cascade(numbers, [("een", first), ("twee", second)]).collect()}
    assert found == {1: ("a", None, "een"), 2: ("y", True, "twee"), 3: (None, None, "none"), None: (None, None, "none")}
    days = spark.createDataFrame([("20240229",), ("2024-02-9",), ("20240230",), ("2024",), (None,)], "t string").select(evidence.register_date(F.col("t")).alias("d"))
    assert [str(r.d) for r in days.collect()] == ["2024-02-29", "None", "None", "None", "None"]


def test_trustmark_status(spark):
    rows = [
        ("thuiswinkel", 200, "lid: Winkel.NL", "winkel.nl", "verified"), ("thuiswinkel", 200, "winkel", "winkel.nl", "likely_verified"), ("thuiswinkel", 200, "abc", "abc.nl", "not_found"),
        ("thuiswinkel", 404, "winkel.nl", "winkel.nl", "check_failed"), ("webwinkelkeur", 200, "Lid van WebwinkelKeur", "x.nl", "verified"), ("webwinkelkeur", 404, None, "x.nl", "not_found"),
        ("trusted shops", 200, None, "x.nl", "not_found"), ("trusted shops", None, "x.nl", "x.nl", "check_failed"), ("trustpilot", 200, "", "x.nl", "not_found"), ("trustpilot", 200, "", "p.nl", "found"),
    ]
    df = spark.createDataFrame(rows, "source string, code int, body string, domain string, want string")
    got = df.select("want", evidence.trustmark_status(F.col("source"), F.col("code"), F.col("body"), F.col("domain"), F.lit("https://www.trustpilot.com/review/p.nl")).alias("got"))
    assert [(r.got, r.want) for r in got.collect() if r.got != r.want] == []


def test_ends_of_stored_lists(spark):
    lists = spark.createDataFrame([(1, [(2, "b"), (9, "z"), (4, "c")]), (2, []), (3, None)], "n int, items array<struct<id:int,v:string>>")
    found = {r.n: (r.a, r.b) for r in lists.select("n", latest.last_of(F.col("items"))["v"].alias("a"), latest.first_of(F.col("items"))["v"].alias("b")).collect()}
    assert found == {1: ("z", "b"), 2: (None, None), 3: (None, None)}
