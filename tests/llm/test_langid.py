import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import langid as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1").select("text", "lang").toPandas()
    ll, n = li.likelihoods(pa.array(docs.text), model)
    right = np.array(model.languages)[ll.argmax(1)] == docs.lang.to_numpy()
    assert model.languages == ["de", "en", "es", "fr"] and right[n > 50].mean() > 0.97


def test_text_scores_do_not_depend_on_neighbours(model):
    texts = ["und die", None, "", "the", "123 !", "é" * 5]
    ll, n = li.likelihoods(pa.array(texts), model)
    for t, own, m in zip(texts, ll, n):
        a, b = li.likelihoods(pa.array([t], pa.string()), model)
        assert (a[0] == own).all() and b[0] == m
    assert n[1] == n[2] == n[4] == 0 and n[3] > 0


def test_host_and_declaration_decide_where_text_cannot(spark, model):
    de = "Der die und das nicht mit von auf ist ein eine zu sich verein keit lich ung schaft"
    rows = [(i, f"http://h{i % 3}.example.de/x", f"<html lang='de'><script>the and of</script><p>{de}") for i in range(60)]
    rows += [(100, "http://h1.example.de/", "<html lang='de'>xq"), (101, "bad url", None), (102, None, "<p>12"), (100, "http://h1.example.de/", "<html lang='de'>xq")]
    got = li.of_pages(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, lang string"), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[0].lang == by[100].lang == "de"
    assert by[101].lang == by[102].lang == "und" and by[101].lang_confidence == 0
    assert (by[0].host, by[0].declared) == ("h0.example.de", "de")


def posterior(rows, model):
    """Languages and confidences of (host, suffix, declared, text) rows, step by step."""
    ll, n = li.likelihoods(pa.array([r[3] for r in rows], pa.string()), model)
    names, k = model.languages, len(model.languages)
    first = [int(ll[i].argmax()) if n[i] else None for i in range(len(rows))]
    kind = [d if d in names or d == "" else "?" for _, _, d, _ in rows]
    total = np.ones(k)
    hosts, suffixes, said = {}, {}, {}
    for (h, s, _, _), d, t in zip(rows, kind, first):
        if t is not None:
            total[t] += 1
            hosts.setdefault((h, s), np.zeros(k))[t] += 1
            suffixes.setdefault(s, np.zeros(k))[t] += 1
            said.setdefault(d, np.zeros(k))[t] += 1
    seen = sum(said.values(), np.zeros(k))
    out = []
    for i, ((h, s, _, _), d, t) in enumerate(zip(rows, kind, first)):
        if t is None:
            out.append(("und", 0.0))
            continue
        own = np.eye(k)[t]
        a, b = hosts[h, s] - own, suffixes[s] - own
        prior = (b + li.SUFFIX * total / total.sum()) / (b.sum() + li.SUFFIX)
        prior = (a + li.HOST * prior) / (a.sum() + li.HOST)
        score = ll[i] + np.log((said[d] + li.TABLE) / (seen + li.TABLE * (k + 2))) + np.log(np.maximum(prior, 1e-12))
        p = np.exp(score - score.max())
        out.append((names[int(score.argmax())], 1 / p.sum()))
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_posterior_of_every_row(spark, model, monkeypatch, most):
    """With all hosts broadcast, and with most of them joined by shuffle."""
    monkeypatch.setattr(li, "BROADCAST", most)
    rng = np.random.default_rng(3)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]
    rows = []
    for i, text in enumerate(docs):
        words = (text or "").split()
        cut = " ".join(words[: int(rng.integers(0, 9))])
        rows.append((i, f"http://h{rng.integers(0, 7)}.x.{['de', 'fr', 'com'][rng.integers(0, 3)]}/p", ["", "<html lang=de>", "<html lang='xx'>"][rng.integers(0, 3)] + cut))
    got = {r.page_id: r for r in li.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    parts = [(u.split("/")[2], u.split("/")[2].rpartition(".")[2], "de" if "lang=de" in h else "xx" if "xx" in h else "", " " * (">" in h) + h.rpartition(">")[2]) for _, u, h in rows]
    for (i, _, _), (lang, sure) in zip(rows, posterior(parts, model)):
        assert got[i].lang == lang and abs(got[i].lang_confidence - sure) < 1e-9


def test_ties_go_to_the_first_by_name(spark):
    model = li.Model(["aa", "bb"], np.full((li._NONE + 1, 2), -1.0))
    got = li.of_pages(spark.createDataFrame([(1, "http://h.zz/", "word")], "page_id long, url string, html string"), model).first()
    assert got.text_lang == "aa"


def test_every_label_is_fitted_and_repeats_change_nothing(spark):
    """A label of one row in thousands is learnt; null ids, repeated rows and very long texts are."""
    rows = [(None if i % 3 else i, "the and of to in that is was for " * 3, "en") for i in range(3000)]
    rows += [(5, "und der die das nicht mit von auf ist ein", "de"), (6, None, "fr"), (7, "x", None), (8, "word " * 300_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = li.fit(df), li.fit(df.repartition(7))
    assert one.languages == ["de", "en"] and (one.weights == two.weights).all()


def test_documents_keep_their_columns(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    got = li.of_documents(docs, model)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)


def test_empty_tables(spark, model):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert li.of_pages(pages, model).count() == 0
    none = li.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    one = li.of_pages(spark.createDataFrame([(1, "http://a.de", "und")], pages.schema), none).first()
    assert (one.lang, one.lang_confidence) == ("und", 0.0)
