import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import reading

EASY = "The dog ran to the hill. It was red. I like the big cat. We sat by the log. "
HARD = "Notwithstanding considerable methodological heterogeneity, the interdisciplinary characterisation of nonstationary phenomena, which earlier investigations regarded as inadmissible, necessarily presupposes computational regularisation of observational uncertainties. "


def test_own_prose():
    take = lambda t: " ".join(reading.own_prose(t).split())
    assert take("[quote=a]x [quote]y[/quote] z[/quote] Mine.") == "Mine."
    assert take('<blockquote cite="a">x<blockquote>y</blockquote></blockquote>Mine.<br />More') == "Mine. More"
    assert take("[QUOTE]not mine\nat all\n------\nMine.") == "Mine."
    assert take("On some day tidefox wrote:\n> a\n> b\nMine.\n--\ntidefox\nrig: LX") == "Mine."
    assert take("Mine.\n_______________\nModerator") == "Mine." and take("Mine.\n\nSent from my Fennec 6") == "Mine."
    assert take("A [b]bold[/b] **word** &amp; more [url=http://a.b/c]here[/url] http://x.y/z​ end.") == "A bold word & more here end."
    assert take("Mine.\n```\ncode = 1\n```\n[code]a b[/code]<pre>c</pre>\n026051 WARN swath=880 dz=1.987 rc=0x8e\n411562.301\t5879637.086\t297.48\t0") == "Mine."
    assert take("[deleted]") == take("<deleted by user>") == take(None) == take("") == take(" \n ") == ""


def test_quotes_of_any_depth():
    for deep in (1, 49, 60, 3000):
        assert reading.own_prose("[quote=a]" * deep + "theirs " + "[/quote]" * deep + "\nMine.").split() == ["Mine."]
        assert reading.own_prose("<blockquote>" * deep + "theirs " + "</blockquote>" * deep + "\nMine.").split() == ["Mine."]
    assert reading.own_prose("Mine. [quote]a [quote]b[/quote]\n------\nMore.").split() == ["Mine.", "More."]
    assert reading.own_prose("Mine. [/quote] More.").split() == ["Mine.", "More."]
    assert reading.own_prose("Mine. [quote]a\n[quote]b\n------\nc[/quote] d").split() == ["Mine."]


def test_long_attributions_and_tags():
    assert reading.own_prose("On " + "a very long day " * 20 + "tidefox wrote:\n> a\nMine.").split() == ["Mine."]
    assert reading.own_prose('Mine <a href="' + "x" * 900 + '">here</a> [url=' + "y" * 900 + "]too[/url].").split() == ["Mine", "here", "too."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(1, 18)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean(rows):
    score, grade = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    cuts, levels = reading.isotonic(score, grade)
    assert (np.diff(levels) > 0).all() and (np.diff(cuts) >= 0).all() and len(cuts) == len(levels) - 1
    fitted = levels[np.searchsorted(cuts, score, "right")]
    assert np.isclose(fitted.mean(), grade.mean())


def test_ranker_orders_graded_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 5))
    grade = np.clip(np.round(8 + 4 * x[:, 0] - 2 * x[:, 3]), 1, 18)
    ranker = reading.fit_ranker(x[:150], grade[:150], tuple(range(5)))
    assert np.corrcoef(ranker.score(x[150:]), grade[150:])[0, 1] > 0.97
    assert np.abs(ranker.grade(x[150:]) - grade[150:]).mean() < 1.0


def posts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, words string, _key int, _grade double")


def test_levels(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(60):
        hard = i % 2
        rows.append((i, (HARD if hard else EASY) * int(rng.integers(2, 5)), "", 0, 0.0))
        labels += [(i, "r1", 17 if hard else 3), (i, "r2", None)]
    rows += [(100, HARD * 3, "", 0, 0.0), (101, EASY * 5, "", 0, 0.0), (102, f"[quote]{HARD * 5}[/quote]{EASY * 3}", "", 0, 0.0), (103, None, "", 0, 0.0), (104, "", "", 0, 0.0), (105, "[deleted]", "", 0, 0.0), (None, HARD, "", 0, 0.0)]
    rows += [(106, EASY * 20_000, "", 0, 0.0), (107, "Der Batterieladegerät war gestern wieder nass. Das Fahrradanhängerschloss ist nicht da und der Wetterbericht war auch nicht gut. " * 4, "", 0, 0.0)]
    graded = spark.createDataFrame(labels, "doc_id long, rater string, grade int")
    got = {r["doc_id"]: r for r in reading.reading_levels(posts(spark, rows), graded).collect()}
    assert len(got) == len(rows)
    assert got[100]["grade"] > 15 and got[101]["grade"] < 5 and got[102]["grade"] < 5 and got[106]["grade"] < 5
    assert all(got[k]["grade"] is None and got[k]["words"] == 0 for k in (103, 104, 105))
    assert not got[107]["english"] and got[100]["english"]


def test_no_labels(spark):
    df = posts(spark, [(1, EASY, "", 0, 0.0)])
    none = spark.createDataFrame([(1, "r", None)], "doc_id long, rater string, grade int")
    assert reading.reading_levels(df, none).first()["grade"] is None
    assert reading.reading_levels(df.limit(0), none).count() == 0
