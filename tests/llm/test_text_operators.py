"""The text operators against brute force, on small awkward tables."""

import base64
import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkstrat.llm import bpe, common, exact_dedup, language_id, line_quality, near_dedup, packing, pii, substring_dedup, token_counts, tokens, toxicity

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 37} other{i}" for i in range(4000))
PASSAGE = "this passage of many words is found in more than one of the documents and has well over a hundred bytes in it. "
TEXTS = [
    None, "", "  ", "a b  c", "a b c", "A B c", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven",
    LONG, LONG + " end", "x" + PASSAGE + "tail one", "head " + PASSAGE + "tail two " + PASSAGE, "é ü ß\n\n" + PASSAGE, "-" * 400, "ab" * 200, "12 <|endoftext|> x", "\x1c\x85 　z's  \n y",
    "write to me.now@mail.example.com or +1 (132) 555-1352, 10.0.0.300, 4111 1111 1111 1111 and 1.2.3.4 end", "!!! ??? 123",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr"][i % 2], None if i == 3 else f"s{i % 3}", "clash", 7) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s1", "clash", 7), (None, "no id here", None, "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score int")


def all_texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact_dedup(docs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    groups: dict = {}
    for i, t in all_texts(docs):
        groups.setdefault(norm(t), []).append(i)
    for block in (4, 16384):
        out = exact_dedup.exact_groups(docs, block_bytes=block).collect()
        assert len(out) == len(TEXTS) + 2 and sum(r.kept for r in out) == len(groups)
        names = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        assert all(r.group_size == len(names[r.text_sha256]) and r.keep_id == min(names[r.text_sha256], key=lambda x: (x is None, x)) for r in out)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_language(docs):
    model = language_id.fit(docs)
    out = language_id.predict(docs, model).collect()
    assert len(out) == docs.count() and {r.lang_pred for r in out} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 13, 18)} == {"und"}
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}
    assert language_id.keep_known(docs, model).columns == docs.columns


def test_line_quality(docs):
    out = {(r.doc_id, r.n_words): r for r in line_quality.line_quality(docs).collect()}
    assert len(out) == len(TEXTS) + 1
    long = out[(8, 8000)]
    assert long.kept and not long.base_failed and long.word_chars == len(LONG.replace(" ", ""))
    assert out[(0, 0)].base_failed and out[(0, 0)].gone == []
    assert line_quality.clean(docs).columns == docs.columns


def test_line_quality_removes_common_lines(spark):
    rows = [(i, "License text here\n" + " ".join(f"w{i}x{k}" for k in range(80)), "h") for i in range(5)] + [(9, "\n".join(["License  TEXT here"] * 40), "h")]
    rows += [(20 + i, " ".join(f"v{i}x{k}" for k in range(80)), "h") for i in range(14)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = {"max_percent": 25, "min_docs": 4}
    out = {r.doc_id: r for r in line_quality.line_quality(table, **limits).collect()}
    assert all(out[i].kept and out[i].n_removed_words == 3 for i in range(5)) and all(out[20 + i].n_removed_words == 0 for i in range(14))
    assert not out[9].kept and out[9].n_removed_words == 120
    clean = {r.doc_id: r.text for r in line_quality.clean(table, **limits).collect()}
    assert set(clean) == set(out) - {9} and clean[0] == rows[0][1].split("\n")[1]
    for other in ({"max_percent": 30, "min_docs": 4}, {"max_percent": 25, "min_docs": 7}):  # 6 documents of 20 hold the line
        assert line_quality.line_quality(table, **other).where("n_removed_words > 0").count() == 0


def test_line_quality_counts_documents(spark):
    page = "License text here\n" + " ".join(f"w{k}" for k in range(80))
    rows = [(i, page, "h") for i in range(5)] + [(7, "Other line\n" + " ".join(f"v{k}" for k in range(80)), "h")] * 5
    out = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=4).collect()}
    assert all(out[i].n_removed_words == 83 and not out[i].kept for i in range(5)) and out[7].n_removed_words == 0 and out[7].kept


def shingle_sets(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in all_texts(docs):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(low)) if x]
        yield i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup(docs):
    sets = list(shingle_sets(docs))
    up = list(range(len(sets)))
    find = lambda a: a if up[a] == a else find(up[a])
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    groups: dict = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(find(a), []).append(i)
    wanted = sorted((i, min(g, key=lambda x: (x is None, x))) for g in groups.values() for i in g if i is not None)
    out = near_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id is not None) == wanted and sum(r.kept for r in out) == len(groups)
    assert near_dedup.dedup(docs).columns == docs.columns
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    out = [r for r in packing.pack(docs, JSON).collect()]
    for i, text in all_texts(docs):
        if i in (None, 5):
            continue
        ids, at = t.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    sizes: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack(docs.limit(0), JSON).count() == 0


def test_drr_keeps_proportions():
    entries = [("a", 300)] * 60 + [("b", 100)] * 60
    taken: dict = {"a": 0, "b": 0}
    for k, (i, _, n) in enumerate(packing.drr(entries, {"a": 0.75, "b": 0.25}, {})):
        taken[entries[i][0]] += n
        if k > 20 and k < 100:
            assert abs(taken["a"] - 3 * taken["b"]) <= 3 * 1024
    assert taken == {"a": 18000, "b": 6000}


def test_packing_mixes_a_table_stored_by_source(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1 << 14)
    rows = [(i, " ".join(f"word{(i * k) % 53}" for k in range(1, 150)), "abc"[i // 150]) for i in range(450)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), JSON).collect()
    total = sum(r.length for r in out)
    own = {s: sum(r.length for r in out if r.source == s) / total for s in "abc"}
    windows: dict = {}
    for r in out:
        found = windows.setdefault(r.sequence_id, dict.fromkeys("abc", 0))
        found[r.source] += r.length
    whole = [w for w in windows.values() if sum(w.values()) == 1024]
    assert len(whole) == total // 1024 >= 64 and all(abs(w[s] / 1024 - own[s]) <= 0.36 for w in whole for s in "abc")


def test_cuts_deal_every_token_at_its_share():
    tokens = [700_001, 300, 41_000, 5, 90_000]
    for share in ([t / sum(tokens) for t in tokens], [0.2, 0.0, 0.5, 0.1, 0.2]):
        cuts = packing.Cuts(tokens, share, 1 << 14)
        ends = [cuts.at(b) for b in range(-(-sum(tokens) // (1 << 14)) + 1)]
        assert all(e.sum() == min(b << 14, sum(tokens)) for b, e in enumerate(ends)) and all((b >= a).all() for a, b in zip(ends, ends[1:]))
        for i, n in enumerate(tokens):
            parts = [x for k in range(0, n, 999) for x in cuts.parts(i, k, min(999, n - k))]
            assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and all(ends[b][i] <= lo < hi <= ends[b + 1][i] for b, lo, hi in parts)


def test_pii(docs):
    marked = {r.doc_id: r.pii for r in pii.annotate(docs).where("doc_id is not null").collect()}
    text = TEXTS[17]
    found = [(pii.KINDS[s.kind], text[s.start : s.end]) for s in marked[17].base_spans]
    assert found == [("email", "me.now@mail.example.com"), ("phone", "+1 (132) 555-1352"), ("card", "4111 1111 1111 1111"), ("ip", "1.2.3.4")]
    assert "@" not in marked[17].sanitised and "10.0.0.300" in marked[17].sanitised and marked[0].sanitised is None and marked[8].sanitised == LONG
    assert pii.sanitise(docs).columns == docs.columns


def test_pii_terms(spark):
    fill = lambda i: " ".join(f"filler{i}n{k}" for k in range(6))
    rows = [(i, f"{fill(i)} Zaphod42 wrote extra{i} from zb@mail.example.org today") if i < 6 else (i, f"wrote {fill(i)} from today") for i in range(200)]
    out = {r.doc_id: r for r in pii.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s.value for s in out[i].pii.term_spans] == ["Zaphod42"] and "Zaphod42" not in out[i].pii.sanitised for i in range(6))
    assert not any(out[i].pii.term_spans for i in range(6, 200))


def test_pii_terms_beside_copies(spark):
    fill = lambda i: " ".join(f"filler{i}n{k}" for k in range(6))
    texts = [f"{fill(i)} Zaphod42 wrote extra{i} from zb@mail.example.org today" if i < 5 else f"wrote {fill(i)} from today" for i in range(200)]
    rows = list(enumerate(texts + [texts[0]] * 36))
    out = {r.doc_id: r for r in pii.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 236 and all([s.value for s in out[i].pii.term_spans] == (["Zaphod42"] if i < 5 or i >= 200 else []) for i in out)


def test_pii_terms_far_from_their_entity(spark):
    fill = lambda i: " ".join(f"filler{i}n{k}" for k in range(6))
    near = lambda i: f"{fill(i)} Zaphod42 wrote extra{i} from zb@mail.example.org today"
    texts = [f"zaphod42 {' '.join(f'w{i}x{k}' for k in range(40))} {near(i)}" if i < 3 else near(i) if i < 10 else f"wrote {fill(i)} from today" for i in range(200)]
    texts[150] = f"only ZAPHOD42 is here, {fill(150)}"
    out = {r.doc_id: r for r in pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = {i: [(m.start(), m.end(), m[0]) for m in re.finditer("zaphod42", t, re.I)] for i, t in enumerate(texts)}
    assert {i: [(s.start, s.end, s.value) for s in r.pii.term_spans] for i, r in out.items()} == wanted
    assert not any("zaphod42" in r.pii.sanitised.lower() for r in out.values())


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    wanted = sorted((i if i is not None else -1, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in all_texts(docs))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, JSON).collect()) == wanted


def test_substrings(docs):
    seen, wanted = set(), {}
    for i, t in sorted(enumerate(TEXTS)):
        b, gone, own = (t or "").encode(), set(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen or b[k : k + 100] in own:
                gone.update(range(k, k + 100))
            own.add(b[k : k + 100])
        seen |= own
        wanted[i] = bytes(c for k, c in enumerate(b) if k not in gone)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).where("doc_id is not null").collect()}
    assert {i: bytes(r.kept) for i, r in out.items()} == wanted
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in out.values())


def test_toxicity(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 40)) + (" you horrid villain and horrid" + f" w{i} villain" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels.where("doc_id < 200"))).collect()}
    assert sum(out[i].predicted != y for i, _, y in rows[200:]) <= 2 and 0 <= out[999].score < 0.5
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0").count() == 0


def test_toxicity_learns_rarer_words(spark):
    own = lambda i: " knave" if i % 15 == 0 else f" horrid villain v{i} and villain"
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 40)) + (own(i) + f" u{i} end" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxic, ordinary, _ = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert all(w in toxic and w not in ordinary for w in (b"villain", b"knave"))


def test_toxicity_cases(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "c d", 0, "y"), (None, "e", 1, None), (3, None, 0, None)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, score int, toxic string")
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, "t"), (3, 0, None), (None, 1, None), (2, None, None), (4, 7, None)], "doc_id long, toxic int, text string")
    model = toxicity.fit(clash, labels)
    out = toxicity.score(clash, model)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 5 and out.where("score between 0 and 1").count() == 5
    for none in (toxicity.fit(clash.limit(0), labels), toxicity.fit(clash, labels.where("toxic = 1"))):
        assert none is None and {r.score for r in toxicity.score(clash, none).collect()} == {0.0}
    assert toxicity.score(clash.limit(0), model).count() == 0


def test_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((i if i is not None else -1, struct.pack(f"<{len(e)}I", *e), x.encode()) for i, x in all_texts(docs) for e in [t.encode_ordinary(x)])
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()) == wanted


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (exact_dedup.exact_groups(none), line_quality.line_quality(none), pii.annotate(none), token_counts.token_counts(none, JSON), substring_dedup.remove_repeats(none), bpe.encode(none, RANKS, public_tokenizers.PATTERN), language_id.predict(none, language_id.fit(none))):
        assert out.count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert not kept & {0, 1, 2, 4, 5, 9, 13} and {3, 8, 10, 11, 17} <= kept


def test_flat_encoding_equals_the_library():
    import random

    from tokenizers import Tokenizer

    from sparkstrat.llm import tokens

    rng, letters = random.Random(3), "abcdeinorst'lmv ,.\n\t\r0129é ß«²\xa0\x85ªÀ-#$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", "x<|endoftext|>y", "日本 語 text", " " * 120_000 + "a", "a" * 3000, "it's 10% off\n\n\n  now"]
    found = tokens.flat_encoder(JSON)
    assert found.ranked is not None
    assert found.flat(texts) == [tokens.as_bytes(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]


def test_clashing_columns(spark):
    """Extra columns with the names that operators use for their own stay as they are."""
    names = ["_row", "row", "_key", "_base", "_terms", "_added", "_gone", "_judged", "_doc", "body", "host", "pii", "kept", "gone", "_mixed", "_other", "_r__key", "h", "name", "n", "base", "node", "component"]
    text = "some plain words that make a sentence of more than five, by a.b@c.example"
    rows = [(i, text if i < 2 else f"{text} {' '.join(f'w{i}x{k}' for k in range(60))}", "en", "s", *[f"{c} {i}" for c in names]) for i in range(5)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    left = lambda out: {(r.doc_id, *[r[c] for c in names]) for r in out.collect()}
    given = left(docs)
    assert left(pii.sanitise(docs)) == given and left(language_id.keep_known(docs, language_id.fit(docs))) == given
    assert left(exact_dedup.dedup(docs)) == left(near_dedup.dedup(docs)) == {r for r in given if r[0] != 1}
    assert left(line_quality.clean(docs)) == {r for r in given if r[0] > 1}
    assert [c for c in pii.annotate(docs).columns if c != "pii"] == [c for c in docs.columns if c != "pii"]
    for out in (packing.pack(docs, JSON), token_counts.token_counts(docs, JSON), substring_dedup.remove_repeats(docs), bpe.encode(docs, RANKS, public_tokenizers.PATTERN), line_quality.line_quality(docs)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(5))


def test_packing_sends_small_batches(spark, monkeypatch):
    real = packing._dealt

    def watched(mix):
        run = real(mix)

        def checked(batches):
            for batch in batches:
                if batch.nbytes > 8_000_000:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield from run([batch])

        return checked

    monkeypatch.setattr(packing, "_dealt", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table = spark.createDataFrame([(i, "s") for i in range(80)], "doc_id long, source string").withColumn("text", F.expr("repeat('word ', 40000)")).coalesce(1)
    out = packing.pack(table, JSON).agg(F.sum("length").alias("n"), F.countDistinct("doc_id").alias("docs")).first()
    assert out.n >= 80 * 40000 and out.docs == 80


def test_dealing_keeps_no_chunk():
    import gc
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    n, chunks = 1 << 15, 64  # 8 MB of ids, each chunk cut at the ends of blocks
    mix = SimpleNamespace(value=(["+a"], [n * chunks], [1.0], 20_000))

    def batches(some):
        for i in range(some):
            rows = packing._row_arrays([[(i, 0, n, n)]], [bytes(4 * n)])
            yield pa.record_batch({"task": pa.array([0], pa.int32()), "source": ["+a"], "first": [i * n], "tokens": [n], "base": [0]} | rows)

    list(packing._dealt(mix)(batches(1)))  # what Arrow imports at its first use stays
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        dealt = sum(sum(map(len, out.column("ids").to_pylist())) for out in packing._dealt(mix)(batches(chunks)))
        gc.collect()
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert dealt == 4 * n * chunks and kept < 1_000_000


def test_workers_give_back_what_a_step_kept(spark):
    near_dedup.shingles(b"a few words of a text")
    tokens.flat_encoder(JSON)
    assert near_dedup._HASHES and tokens._ENCODERS and list(common._rested(["batch"])) == ["batch"]
    assert not near_dedup._HASHES and not tokens._ENCODERS
    common.rest(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_pipeline_runs_no_python_in_its_native_stage(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents")
    table = spark.read.parquet(f"{tmp_path}/documents")  # rows from Python would show in the plans

    def ran(stage):
        store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty()
        before = store.executionsList().size()
        stage(spark, table, "").write.format("noop").mode("overwrite").save()
        bus.waitUntilEmpty()
        every = store.executionsList()
        return [bool(re.search("Python|Pandas|Arrow", every.apply(i).physicalPlanDescription())) for i in range(before, every.size())]

    native = ran(corpus_pipeline.sanitise)
    assert len(native) > 2 and not any(native)
    # The workers rest after their last step in the stage before, and the frame that is then written needs none.
    assert ran(corpus_pipeline.drop_near_copies)[-2:] == [True, False]


def test_toxic_dictionaries_hold_every_telling_word():
    ordinary = [f" plain words of number {i} and {i * 7}" for i in range(200)]
    common, rare = [f"abusive{x}word" for x in "qwertzui"], ["vequez", "lostraan", "loweiig"]
    words = [" " + " ".join(common[i % 8 :] + common[: i % 8]) for i in range(300)] + [f" {w}" for w in rare]
    for way in toxicity.WAYS:
        toxic, plain = toxicity.dictionaries({-1: ordinary, 0: words, len(toxicity.LEVELS): [" ente"]}, way, 0)
        assert all(w.encode() in toxic for w in common + rare) and toxic.endswith(plain) and plain.startswith(b" ente")
    assert toxicity.rests("chllaente", {" chll": 5.0, "chlla": 9.0}) == ["ente"]
