import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.language import ALPHA, BUCKET_BITS, DECLARED_RIGHT, HOST_WEIGHT, LANGUAGES, LEAST_KNOWN, LEAST_POSTERIOR, SEED_WEIGHT, SEEDS, SUFFIX_WEIGHT, TEMPER, TextModel, address, declared_language, identify, identify_languages, train_on, with_known_language


def test_held_out_accuracy_of_the_text_model(small_docs):
    """Trained on half of the sources, judged on the other half's texts alone."""
    train, held = small_docs.where("pmod(xxhash64(source), 2) = 0"), small_docs.where("pmod(xxhash64(source), 2) = 1")
    model = train_on(train)
    rows = identify_languages(held, model=model, declared_col=None).join(held.select("doc_id", "lang"), "doc_id").where("known > 0").collect()
    right = [r.text_language == r.lang for r in rows]
    assert len(rows) > 100 and sum(right) / len(right) >= 0.97


def test_fused_accuracy_and_clean_documents_stay(small_docs):
    rows = identify_languages(small_docs).join(small_docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == small_docs.count()
    assert sum(r.language == r.lang for r in rows) / len(rows) >= 0.98
    worded = [r for r in rows if sum(c.isalpha() for c in r.text or "") > 40]
    assert sum(r.accepted for r in worded) / len(worded) >= 0.995


def test_seeds_alone_know_function_words():
    model = TextModel.train(iter(()))
    texts = {"de": "der und die nicht mit für auch wird", "en": "the and that with from this which", "es": "los que para una como pero más", "fr": "les des une est pas pour dans qui"}
    found = model.evidence(list(texts.values()))
    assert [LANGUAGES[i] for i in found[:, : len(LANGUAGES)].argmax(1)] == list(texts)


def test_a_text_is_judged_by_itself():
    model = TextModel.train(iter([("en", "the cat and the dog")]))
    alone = [model.evidence([t])[0].tolist() for t in ("the cat", "", None, "le chat")]
    assert model.evidence(["the cat", "", None, "le chat"]).tolist() == [pytest.approx(a) for a in alone]


def test_long_texts_are_judged_in_slices(monkeypatch):
    model = TextModel.train(iter([("en", "the cat and the dog"), ("fr", "le chat et le chien")]))
    texts = ["the cat " * 50, "", None, "le chien et la " * 400, "the dog"]
    whole = model.evidence(texts)
    monkeypatch.setattr("quarry.llm.language.SLICE", 97)
    assert model.evidence(texts) == pytest.approx(whole)


def test_odd_rows(odd_docs, no_docs):
    rows = identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert not by_id[i].accepted and by_id[i].language == "und" and by_id[i].known == 0.0
    assert identify_languages(no_docs).count() == 0
    kept = with_known_language(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL").count() == 0


def test_markup_address_and_host_turn_a_text_without_evidence(spark):
    """Hosts and suffixes lend their language to short texts; what the markup says counts more."""
    rows = [(i, "der und die nicht mit für auch wird sich dem", None, f"http://h{i % 3}.de/x") for i in range(60)]
    rows += [(100 + i, "les des une est pas pour dans qui sur avec", None, f"http://g{i % 3}.fr/x") for i in range(60)]
    rows += [(200, "qi de", None, "http://h0.de/y"), (201, "qi de", None, "http://new.fr/y"), (202, "<html lang='es'> qi de", None, "http://other/y"), (203, "qi de", "es", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify_languages(docs, model=TextModel.train(iter(()))).collect()}
    flat = {r.doc_id: r for r in identify_languages(docs.where("doc_id >= 200").withColumn("source", F.lit("")), model=TextModel.train(iter(()))).collect()}
    assert got[200].host == "h0.de" and got[200].language == "de" and got[200].posterior > flat[200].posterior + 0.1
    assert got[201].declared is None and got[201].language == "fr" and got[201].posterior > flat[201].posterior + 0.1
    assert got[202].declared == "es" and got[203].declared == "es" and got[202].posterior > 0.5


def restated(rows, sample, languages=LANGUAGES):
    """Text model, priors and posteriors in plain Python: {id: (language, posterior, known)}. rows: id, text, declared, address."""

    def grams(text):
        words = "".join(c if c.islower() and c.isascii() or not c.isascii() else " " for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split()
        letters = (" " + " ".join(words) + "  ").encode() if words else b""
        return [((letters[i] << 16 | letters[i + 1] << 8 | letters[i + 2]) * 0x9E3779B1 % (1 << 32)) >> (32 - BUCKET_BITS) for i in range(len(letters) - 2)]

    counts = {name: Counter() for name in languages}
    for name in languages:
        for g in grams(SEEDS[name]):
            counts[name][g] += SEED_WEIGHT
    for name, text in sample:
        counts[name].update(grams(text))
    sums = {name: sum(c.values()) for name, c in counts.items()}
    seen = set().union(*counts.values())
    weight = {g: {name: math.log((counts[name][g] + ALPHA) / (sums[name] + ALPHA * (1 << BUCKET_BITS))) for name in languages} for g in seen}

    def norm(logs):
        top = max(logs.values())
        parts = {name: math.exp(x - top) for name, x in logs.items()}
        return {name: x / sum(parts.values()) for name, x in parts.items()}

    facts = {}
    for i, text, declared, place in rows:
        own = grams(text)
        logs = {name: TEMPER * sum(weight[g][name] for g in own if g in seen) for name in languages}
        known = sum(g in seen for g in own) / len(own) if own else 0.0
        if declared in languages:
            logs = {name: x + math.log(DECLARED_RIGHT if name == declared else (1 - DECLARED_RIGHT) / (len(languages) - 1)) for name, x in logs.items()}
        host = (place or "").split("://")[-1].split("/")[0]
        facts[i] = logs, known, host, host.rpartition(".")[2] if "." in host else ""
    by_host, by_suffix, whole = defaultdict(Counter), defaultdict(Counter), Counter()
    for logs, known, host, suffix in facts.values():
        for table in (by_host[host], by_suffix[suffix], whole):
            for name, p in norm(logs).items():
                table[name] += p if known >= LEAST_KNOWN else 0.0
    base = {name: (whole[name] + 1) / (sum(whole.values()) + len(languages)) for name in languages}
    out = {}
    for i, (logs, known, host, suffix) in facts.items():
        mid = {name: (by_suffix[suffix][name] + SUFFIX_WEIGHT * base[name]) / (sum(by_suffix[suffix].values()) + SUFFIX_WEIGHT) for name in languages}
        prior = {name: (by_host[host][name] + HOST_WEIGHT * mid[name]) / (sum(by_host[host].values()) + HOST_WEIGHT) for name in languages}
        posterior = norm({name: x + math.log(prior[name]) for name, x in logs.items()})
        best = max(languages, key=lambda name: posterior[name])
        out[i] = best if known >= LEAST_KNOWN and posterior[best] >= LEAST_POSTERIOR else "und", posterior[best], known
    return out


@pytest.mark.parametrize("declared", [True, False])
def test_posteriors_are_those_of_the_rule(spark, declared):
    """Likelihoods, smoothed priors and posteriors of each row, with suffixes and hosts, recomputed in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    docs = docs.withColumn("source", F.concat(F.lit("http://h"), F.col("doc_id") % 7, F.lit("."), F.col("lang"), F.lit("/x"))).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 12)).otherwise(F.col("text")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    rows = docs.select("doc_id", "text", "lang" if declared else F.lit(None), "source").collect()
    sample = [(r.lang, r.text) for r in docs.where("doc_id % 2 = 1 AND lang IN ('de', 'en', 'es', 'fr')").collect()]
    expected = restated([tuple(r) for r in rows], sample)
    got = identify_languages(docs, model=TextModel.train(iter(sample)), declared_col="lang" if declared else None).collect()
    assert len(got) == len(rows) > 100 and len({r.language for r in got}) >= 4
    for r in got:
        language, posterior, known = expected[r.doc_id]
        assert (r.language, r.known) == (language, pytest.approx(known, abs=1e-6)) and r.posterior == pytest.approx(posterior, abs=1e-4)


def test_fused_accuracy_without_any_declaration(small_docs):
    """Trained on half of the sources; the other half is judged by texts, hosts and suffixes alone."""
    train, held = small_docs.where("pmod(xxhash64(source), 2) = 0"), small_docs.where("pmod(xxhash64(source), 2) = 1")
    rows = identify_languages(held, model=train_on(train), declared_col=None).join(held.select("doc_id", "lang"), "doc_id").where("accepted").collect()
    assert len(rows) > 300 and sum(r.language == r.lang for r in rows) / len(rows) >= 0.97


def test_addresses(spark):
    rows = spark.createDataFrame([("http://A.B.fr/x?y",), ("src0",), (None,), ("host.de",), ("",)], "u string")
    host, suffix = address(F.col("u"))
    assert [tuple(r) for r in rows.select(host, suffix).collect()] == [("a.b.fr", "fr"), ("src0", ""), ("", ""), ("host.de", "de"), ("", "")]


def test_the_joined_way_gives_the_same(spark, small_docs, monkeypatch):
    from quarry.llm import language

    model = train_on(small_docs)
    one = sorted((r.doc_id, r.language, round(r.posterior, 6)) for r in identify_languages(small_docs, model=model).collect())
    monkeypatch.setattr(language, "BROADCAST_HOSTS", 0)
    assert sorted((r.doc_id, r.language, round(r.posterior, 6)) for r in identify_languages(small_docs, model=model).collect()) == one


def test_missing_columns(spark):
    docs = spark.createDataFrame([(1, "the and of to in is that")], "doc_id long, text string")
    [row] = identify(docs).collect()
    assert row.language == "en" and row.accepted and row.row.doc_id == 1


def test_declared_language_behind_many_attributes(spark):
    """The tag's end alone bounds the search."""
    long = " ".join(f'data-a{i}="{i}"' for i in range(2000))
    rows = spark.createDataFrame([(0, f"<html {long} lang='es'> x"), (1, f"<html {long}> lang='es'"), (2, "<html lang=fr>"), (3, f"<html {long} lang='es' " + "x" * 100_000)], "i long, t string")
    got = {r.i: r.d for r in rows.select("i", declared_language(F.col("t"), F.lit("de"), LANGUAGES).alias("d")).collect()}
    assert got == {0: "es", 1: "de", 2: "fr", 3: "es"}
