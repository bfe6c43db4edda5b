import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from samples import documents, plain_words, texts, words

from riskframe.llm import components, fingerprints, jaccard_join, language_id, markov_lm, secret_scan


# Jaccard join

def brute_join(rows, k, percent):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, j in product(range(len(rows)), repeat=2):
        both = len(sets[i] & sets[j])
        if i < j and (both and 100 * both >= percent * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,percent,leaf", [(3, 90, 384), (5, 80, 384), (2, 60, 4)])
def test_join(docs, spark, monkeypatch, k, percent, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    base = words(9, 60)
    family = [(i, " ".join(base[:i % 23] + [f"new{i}"] * (i % 4) + base[i % 23 + i % 5:])) for i in range(1, 60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + family
    table = documents(spark, [(d, t, "en", "s") for d, t in rows]).limit(len(rows))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(table, k, percent).collect()), key=str)
    assert got == brute_join([(r.doc_id, r.text) for r in table.collect()], k, percent)


@pytest.mark.parametrize("bits,tasks", [(8, 1), (14, 4)])
def test_bucket_counts(spark, docs, bits, tasks):
    rows = docs.select("text").repartition(tasks)
    found = jaccard_join.bucket_counts(rows, 3, bits)
    each = np.zeros(1 << bits)
    for r in rows.collect():
        for h in jaccard_join.shingle_sets(__import__("pyarrow").array([r.text]), 3)[0]:
            each[int(h) >> (64 - bits)] += 1
    assert len(found) == 1 << bits and np.abs(found - 6 * np.log2(1 + each)).max() < 1


def test_join_of_nothing(nothing):
    assert jaccard_join.join(nothing, 3, 90).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(7, 7), (300, 200)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 301)}


# Fingerprints

def test_fingerprints(docs):
    rows = docs.collect()
    out = fingerprints.compare(docs).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    text = {r.doc_id: r.text or "" for r in rows}
    following = {a.doc_id: b.text or "" for a, b in zip(order, order[1:] + order[:1]) if not (b.doc_id == a.doc_id)}
    same = defaultdict(set)
    for r in out:
        t = text[r.doc_id]
        third = len(t) // 3
        assert r.n_chars == len(t) and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.edited in (t[:len(t) - third] + following[r.doc_id][:third], t[:len(t) - third] + t[:third])
        assert bool(r.sketch) == bool(t.split())
        same[t].add(tuple(r.sketch))
    assert len(out) == len(rows) and all(len(s) == 1 for s in same.values())


def test_sketches_merge_and_estimate(spark):
    a, b = words(1, 4000), words(2, 4000)
    table = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a + b), " ".join(a[:800]))], "a string, b string, c string, d string")
    for c in "abcd":
        table = fingerprints.with_sketch(table, c, f"s{c}")
    r = table.select(fingerprints.merged("sa", "sb").alias("m"), "sc", fingerprints.containment("sd", "sc").alias("inside"),
                     fingerprints.likeness("sa", "sc").alias("like"), fingerprints.likeness("sa", "sb").alias("unlike")).first()
    assert len(set(r.m) ^ set(r.sc)) <= 4 and r.inside > 0.95 and 0.35 < r.like < 0.65 and r.unlike < 0.1


def test_fingerprints_of_few(spark, nothing):
    assert fingerprints.compare(nothing).count() == 0
    one = fingerprints.compare(documents(spark, [(3, "abc def", "en", "s")]).limit(1)).first()
    assert one.edited == "abc dab" and one.near_next == 1.0


# Language model

def test_model_likelihood_is_exact():
    rng = np.random.default_rng(2)
    model = markov_lm.HiddenMarkov(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 4)))))
    sequences = [np.array(s, "<u2") for s in ([0], [1, 3, 2], [2, 2, 0, 1, 3])]
    want = [math.log10(sum(model.start[p[0]] * model.emits[p[0], s[0]] * math.prod(
        model.moves[a, b] * model.emits[b, c] for a, b, c in zip(p, p[1:], s[1:])) for p in product(range(3), repeat=len(s)))) for s in sequences]
    assert np.allclose(model.likelihoods(sequences), want)
    starts, moves, emits, log, n = model.expected(sequences)
    assert np.isclose(log / math.log(10), sum(want)) and n == 9
    assert np.isclose(starts.sum(), 3) and np.isclose(moves.sum(), 6) and np.isclose(emits.sum(), 9)


@pytest.mark.parametrize("head", [0, 10, 1000])
def test_scores(docs, monkeypatch, head):
    monkeypatch.setattr(markov_lm, "HEAD", head)
    monkeypatch.setattr(markov_lm.vocabulary_of, "__defaults__", (head,))
    rows = markov_lm.score(docs, states=2, own_classes=8, shared_classes=5, rounds=3).collect()
    tokens = Counter()
    for r in docs.collect():
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            tokens.update(plain_words(r.text) + [" "])
    n, v = sum(tokens.values()), len(tokens)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        own = plain_words(text[r.doc_id]) + [" "]
        assert r.train_tokens == n and r.n_tokens == len(own) and r.n_known == sum(w in tokens for w in own)
        assert math.isclose(r.base_score, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_model_beats_word_counts(spark):
    rows = [(i, " ".join((words(i % 5, 40) if i % 2 else ["uno", "dos", "tres", "que"] * 10)), "en", "s") for i in range(200)]
    out = [r for r in markov_lm.score(documents(spark, rows), states=2, own_classes=50, shared_classes=3).collect() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_nothing(nothing):
    assert markov_lm.score(nothing).count() == 0


# Secrets

def brute_spans(text):
    found = []
    for rank, (kind, pattern, flags, group, least) in enumerate((
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24))):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return sorted(found)


def test_secrets(docs, nothing):
    out = secret_scan.scan(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count() and secret_scan.scan(nothing).count() == 0
    for r in out:
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind in secret_scan.BASE] == [
            (a, b, k) for a, _, b, k in brute_spans(text[r.doc_id])]
    assert any(s.kind == "prefixed" and s.live for r in out for s in r.spans)


def test_copied_values_are_examples(spark):
    value = "token = q8Zr1TkV0sXw4Yb7"
    rows = [(i, value if i < 5 else "token = m3Jd9LpQ2nHc6Gt5", "en", f"owner{i if i < 5 else 9}/repo{i}") for i in range(8)]
    out = {r.doc_id: r.spans[0] for r in secret_scan.scan(documents(spark, rows)).collect()}
    assert [out[i].live for i in (0, 4, 5, 7)] == [False, False, True, True]
    assert (out[0].owners, out[0].repositories, out[6].owners, out[6].repositories) == (5, 5, 1, 3)


# Language

def test_languages(spark, nothing):
    kinds = {"en": "the house and the tree of that which", "fr": "le chat et la maison que nous avons été", "de": "der hund und die straße ist nicht über"}
    rows = [(i, " ".join(w for _ in range(5) for w in sorted(t.split(), key=lambda w: hash((w, i)) % 7)), lang, f"{lang}.host.{lang}")
            for i, (lang, t) in enumerate(list(kinds.items()) * 30)]
    rows += [(900, kinds["fr"] * 3, "en", "fr.host.fr"), (901, kinds["de"] * 3, None, None), (902, None, "en", "en.host.en"), (903, "123 !!", "en", None)]
    table = language_id.document_rows(documents(spark, rows), __import__("pyspark").sql.functions.col("doc_id"))
    out = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert len(out) == len(rows) and all(out[d].lang == l for d, _, l, _ in rows[:90])
    assert out[900].lang == "fr" and out[901].lang == "de" and out[901].accepted
    assert not out[902].accepted and not out[903].accepted and out[902].lang == "en"
    empty = language_id.document_rows(nothing, __import__("pyspark").sql.functions.col("doc_id"))
    assert language_id.identify(empty).count() == 0


def test_rare_and_unknown_languages(spark):
    import corpus_pipeline
    col = __import__("pyspark").sql.functions.col
    kinds = {"en": "the house and the tree of that which they have seen with their own children before winter came",
             "de": "der hund und die straße ist nicht über den berg gegangen weil das wetter schlecht geworden war",
             "fi": "koira juoksi metsään koska ilma oli kaunis ja lapset halusivat leikkiä järven rannalla yhdessä"}

    def say(lang, i):
        return " ".join(w for k in range(4) for w in random.Random(100 * i + k).sample(kinds[lang].split(), 12))

    rows = [(i, say(lang, i), lang, "s") for i in range(500) for lang in ("en", "de")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(2000 + i, say("fi", i), "fi", "s") for i in range(4)] + [(3000, say("fi", 99), None, "s")]
    strange = [(4000, "ο σκύλος έτρεξε στο δάσος γιατί ο καιρός ήταν καλός και τα παιδιά ήθελαν να παίξουν", None, "s"),
               (4001, "kutya szaladt az erdőbe mert szép idő volt és gyerekek játszani akartak tónál együtt mindannyian", None, "s")]
    docs = documents(spark, rows + strange)
    out = {r.doc_id: r for r in language_id.identify(language_id.document_rows(docs, col("doc_id"))).collect()}
    assert all(out[d].lang == lang and out[d].accepted for d, _, lang, _ in rows if d != 3000)
    assert out[3000].lang == "fi" and out[3000].accepted and not out[4000].accepted and not out[4001].accepted
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").select("doc_id").collect()}
    assert kept == {r[0] for r in rows}
    silent = documents(spark, [(d, t, None, s) for d, t, _, s in rows[:5]])
    assert corpus_pipeline.language(spark, silent, "").count() == 6


def test_stray_tags_do_not_confirm_themselves(spark):
    col = __import__("pyspark").sql.functions.col
    english = ("the house and tree of that which they have seen with their own children before winter came over hills where "
               "nobody had ever walked without shoes since long ago when rivers were frozen").split()
    finnish = "koira juoksi metsään koska ilma oli kaunis ja lapset halusivat leikkiä järven rannalla yhdessä".split()

    def say(vocabulary, seed):
        r = random.Random(seed)
        return " ".join(w + "s" * (r.random() < 0.1) for _ in range(5) for w in r.sample(vocabulary, 12))

    rows = [(i, say(english, i), "en", "s") for i in range(580)] + [(1000 + i, say(english, 1000 + i), f"x{i}", "s") for i in range(20)]
    rows += [(2000 + i, say(finnish, i), "fi", "s") for i in range(4)] + [(3000, say(finnish, 99), None, "s"), (3001, say(finnish, 98), "en", "s")]
    rows += [(4000, rows[585][1], "en", "s"), (5000, say(english, 1) * 60, "x1", "s"), (5001, "the", None, "s")]
    out = {r.doc_id: r for r in language_id.identify(language_id.document_rows(documents(spark, rows).limit(len(rows)), col("doc_id"))).collect()}
    english_ids = [d for d, *_ in rows if d < 2000 or d in (4000, 5000)]
    assert {out[d].lang for d in english_ids} == {"en"} and all(out[d].accepted for d in english_ids)
    assert all(out[d].lang == "fi" and out[d].accepted for d in (2000, 2001, 2002, 2003, 3000, 3001))


def test_page_languages(spark, nothing):
    page = "<html lang='{}'><head><style>p {{}}</style><script>var the = 1</script></head><body><p>{}</p></body></html>"
    kinds = {"en": "the house and the tree of that which we have seen", "fr": "le chat et la maison que nous avons été voir"}
    rows = [(i, f"https://h{i % 5}.site.{lang}/x", page.format(lang, text * (1 + i % 4))) for i in range(60) for lang, text in kinds.items()]
    rows += [(900, None, page.format("en", kinds["fr"] * 3)), (901, "nowhere", None), (902, "https://a.site.fr/", ""), (903, "https://a.site.fr/", page.format("", kinds["fr"]))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language_id.identify(language_id.page_rows(table, table.page_id)).collect()
    assert len(got) == len(rows) and all(r.lang == r.declared and r.accepted for r in got if r.page_id < 900)
    out = {r.page_id: r for r in got}
    assert out[900].lang == out[903].lang == "fr" and out[903].accepted and out[903].declared is None
    assert not out[901].accepted and not out[902].accepted and out[902].lang == "fr"
    assert language_id.identify(language_id.page_rows(table.limit(0), table.page_id)).count() == 0


def test_texts_are_awkward():
    assert None in texts() and "" in texts() and max(len(t or "") for t in texts()) > 90_000
