import pytest

from corvane.functions import names as N
from corvane.functions.vocab import ENTITIES
from corvane.operators.enrich import enrich, region_entries

WHO, WHERE = N.Gazetteer(ENTITIES), N.Gazetteer(region_entries())


def test_titles_roles_and_keys():
    assert N.strip_titles("Dr. Budi Santoso, S.E., M.Sc.") == "Budi Santoso"
    assert N.strip_titles("Dr.") == "Dr."
    assert N.strip_role("Menteri Keuangan Budi Santoso") == "Budi Santoso"
    assert N.strip_role("Keuangan Budi") == "Keuangan Budi"  # a field goes only behind an office
    assert N.canonical_key("Prof. Budi  Santoso, M.M.") == "budi santoso"


def test_gazetteer():
    assert [h.owner for h in WHO.find("kpk dan KPK memeriksa bank indonesia")] == ["org_kpk", "org_bi"]  # acronyms keep their case
    assert [h.owner for h in WHO.find("Partai Golkar")] == ["party_golkar"]  # the longer of two hits
    shared = N.Gazetteer([("a", "Alfa", "X", [], ["same"]), ("b", "Beta", "X", [], ["same"])])
    assert shared.find("same Alfa") and [h.owner for h in shared.find("same")] == []


def test_actors():
    got = N.actors("Kemarin Rina Wati bertemu Prabowo Subianto. Rina Wati diam.", WHO)
    # a run that holds a word which is no name is none; the later mention counts
    assert [(a["canonical_key"], a["entity_id"]) for a in got] == [("prabowo subianto", "per_prabowo"), ("rina wati", None)]
    assert [a["display"] for a in N.actors("kata Rina Wati dan Rina Wati", WHO)] == ["Rina Wati"]


def test_regions():
    got = N.regions("Banjir di Surabaya", "Warga Surabaya mengungsi. Surabaya lumpuh. Medan aman.", WHERE)
    assert [(r["region_id"], r["confidence"]) for r in got] == [("reg_surabaya", 1.0), ("reg_medan", 0.5)]


@pytest.mark.parametrize(
    ("text", "method", "who", "confidence"),
    [
        ('"Kami siap," kata Rina Wati.', "trailing", "Rina Wati", 0.85),
        ('"Kami siap," ujar Prabowo Subianto.', "trailing", "Prabowo Subianto", 0.95),
        ('Rina Wati mengatakan, "Kami siap."', "leading", "Rina Wati", 0.85),
        ('"Kami siap," kata Rina Wati, "dan kuat."', "split", "Rina Wati", 0.85),
        ('"Kami siap."', "trailing", None, 0.4),
    ],
)
def test_quotes(text, method, who, confidence):
    q = N.quotes(text, "http://x", WHO)
    assert len(q) == 1 and (q[0]["method"], q[0]["speaker_display"], q[0]["confidence"]) == (method, who, confidence)
    assert q[0]["exposable"] == (who is not None)


def test_continuation_is_never_served():
    q = N.quotes('"Kami siap," kata Rina Wati. "Besok mulai," katanya. Ia menambahkan, "Semua baik."', "u", WHO)
    assert [(x["method"], x["speaker_display"], x["exposable"]) for x in q] == [("trailing", "Rina Wati", True), ("continuation", "Rina Wati", False), ("continuation", "Rina Wati", False)]


def test_enrich(spark):
    df = spark.createDataFrame([("a", "KPK periksa bank di Medan", "“Kasus suap ini besar,” kata Rina Wati yang hadir di sana.", "Hukum", "http://x"), ("b", None, None, None, None)], "article_id string, title string, excerpt string, raw_category string, canonical_url string")
    got = {r.article_id: r for r in enrich(df).collect()}
    assert got["a"].language == "id" and got["b"].language == "id"
    assert [t.topic for t in got["a"].topics][:2] == ["hukum", "korupsi"] and got["b"].topics == []
    assert [r.region_id for r in got["a"].regions] == ["reg_medan"] and got["a"].quotes[0].exposable
    assert "org_kpk" in [a.entity_id for a in got["a"].actors]
