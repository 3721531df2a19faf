"""The registered queries on a small table, each against its contract by brute force."""

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sparkstrat.llm import language_id, packing, queries

PASSAGE = "a passage of many words that is found in more than one document and that is over a hundred bytes long, as it must be. "
WORDS = {"en": "the of and to in that with which this from they were been have their", "fr": "les des une dans pour qui sur avec sont est aux plus par cette mais", "xx": "qoq zaz wuw kik yoy"}
SPACE, SYMBOLS = "[\x20\x09-\x0d]+", "#*$%&|<>"


def _rows():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(160):
        lang = "xx" if i % 40 == 39 else ["en", "fr"][i % 2]
        text = " ".join(rng.choice(WORDS[lang].split(), 70)) + f" u{i}."
        if i % 4 == 0:
            text = "Shared  Footer LINE\n" + text + "\n\tshared footer line\n"
        if i % 10 == 3:
            text += " " + PASSAGE + "# $ & |"
        if i % 8 == 1:
            text += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and you.{i}@mail.example.com, 10.0.{i}.300 4111 1111 1111 1111, 1.2.3.{i} +1 (132) 555-13{i:02}'
        if i % 5 == 2 and lang == "en":
            text += f" scoundrel{i} you scoundrel"
        rows.append((i, text, lang, [None, "", "hot", "hot"][i % 4], i))
    rows += [(200, None, "en", "hot", 0), (201, "", None, None, 0), (202, "123 !!", "en", "hot", 0), (203, rows[1][1], "fr", "hot", 0), (204, rows[1][1].replace(" ", "  "), "fr", "", 0), (205, " ".join(["same few words here"] * 20), "en", "hot", 0)]
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("scoundrel" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    return folder, {i: (t or "", lang, source) for i, t, lang, source, _ in rows}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, table):
    folder, rows = table
    groups = {}
    for i, (t, _, _) in rows.items():
        groups.setdefault(re.sub(SPACE, " ", t), []).append(i)
    wanted = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op1_exact_dedup(spark, folder).collect()} == wanted


def test_op2(spark, table):
    folder, rows = table
    out = {r.doc_id: r for r in queries.op2_language_id(spark, folder).collect()}
    assert set(out) == set(rows) and all(r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 for i, r in out.items())
    assert all(out[i].lang_pred == "und" for i in (200, 201, 202))
    held = [i for i in range(160) if out[i].held_out]
    assert np.mean([out[i].lang_pred == rows[i][1] for i in held]) > 0.95 and "xx" in {r.lang_pred for r in out.values()}
    with pytest.raises(ValueError):
        language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"), max_langs=2)


def test_op3(spark, table):
    folder, rows = table
    split = lambda t: [w for w in re.split(SPACE, t) if w]
    normal = lambda x: " ".join(split("".join(c.lower() if c.isascii() else c for c in x)))
    held, hosts = {}, {}
    for i, (t, _, host) in rows.items():
        hosts.setdefault(host, set()).add(i)
        for x in t.split("\n"):
            held.setdefault((host, normal(x)), set()).add(i)
    wanted = {}
    for i, (t, _, host) in rows.items():
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        gone = [x for x in lines if len(held[host, normal(x)]) >= 20 and 100 * len(held[host, normal(x)]) > 5 * len(hosts[host])]
        lost, failed = sum(len(split(x)) for x in gone), len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        wanted[i] = (len(words), sum(map(len, words)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(repeated), failed, not failed and 2 * lost <= len(words), lost)
    out = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in queries.op3_line_quality(spark, folder).collect()}
    assert out == wanted and sum(x[-1] > 0 for x in wanted.values()) >= 20


def test_op6(spark, table):
    folder, rows = table
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def right(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else None, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    out = {r.doc_id: r for r in queries.op6_pii(spark, folder).collect()}
    assert set(out) == set(rows)
    for i, (t, _, _) in rows.items():
        base = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, t) if right(kind, m.group()))
        found = [f"{kind}:{a}:{b}" for a, _, b, kind in base]
        assert [getattr(out[i], f"n_{kind}") for kind in kinds] == [sum(x[3] == kind for x in base) for kind in kinds]
        assert out[i].base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        spans = out[i].spans.split(",") if out[i].spans else []
        assert [s for s in spans if s.split(":")[0] in kinds] == found
        more = {t[int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans) if kind not in kinds}
        if "token" in t:  # the secret, and the word that gives it away
            assert "token" in more and re.search('"(.+?)"', t).group(1) in more
        else:
            assert not more


def test_op8(spark, table):
    folder, rows = table
    out = {r.doc_id: r for r in queries.op8_substring_dedup(spark, folder).collect()}
    seen = set()
    for i, (t, _, _) in sorted(rows.items()):
        data, gone = t.encode(), set()
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(data[p : p + 100])
        spans = sum(p - 1 not in gone for p in gone)
        kept = bytes(c for p, c in enumerate(data) if p not in gone)
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(data), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op9(spark, table):
    folder, rows = table
    out = {r.doc_id: r for r in queries.op9_toxicity(spark, folder).collect()}
    assert set(out) == set(rows) and all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    held = [i for i in rows if out[i].held_out and rows[i][0]]
    assert np.mean([out[i].predicted == int("scoundrel" in rows[i][0]) for i in held]) > 0.9


def test_op7_and_op10(spark, table):
    import tiktoken
    from tokenizers import Tokenizer

    folder, rows = table
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op7_token_counts(spark, folder).collect():
        n = len(library.encode(rows[r.doc_id][0], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id][0].encode()), n, n > 512)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op10_byte_bpe(spark, folder).collect():
        ids = coder.encode_ordinary(rows[r.doc_id][0])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][0].encode()).hexdigest()


def _texts_by_pieces(pieces):
    """doc_id: (tokens, total) with all pieces checked to be gapless in their documents and sequences."""
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at, parts in [*sequences.items(), *((None, [x[:2] for x in p]) for p in docs.values())]:
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert at is None or end <= 1024
    return docs


def test_op5(spark, table):
    from tokenizers import Tokenizer

    folder, rows = table
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = queries.op5_packing(spark, folder).collect()
    assert {r.source for r in pieces} == {None, "", "hot"} and all(r.source == rows[r.doc_id][2] for r in pieces)
    found = _texts_by_pieces(pieces)
    assert set(found) == set(rows)
    for i, parts in found.items():
        ids = [*library.encode(rows[i][0], add_special_tokens=False).ids, 0]
        for start, length, total, check in parts:
            assert total == len(ids) and check == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
    # Targets other than the sources' own shares: in every window but those in which a source has run out.
    mixed = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), targets={"hot": 0.2, "": 0.4, None: 0.4}).collect()
    windows = {}
    for r in mixed:
        windows.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
    full = [w for _, w in sorted(windows.items()) if sum(sum(x) for x in w.values()) == 1024][:8]
    assert all(abs(sum(w.get("hot", [])) / 1024 - 0.2) <= 0.5 for w in full) and abs(np.mean([sum(w.get("hot", [])) / 1024 for w in full]) - 0.2) < 0.1


def test_pipeline(spark, table):
    folder, rows = table
    out = corpus_pipeline.run(spark, folder).collect()
    found = _texts_by_pieces(out)
    kept = {}
    for i, (t, _, _) in sorted(rows.items()):
        if re.search("[a-z]", t):
            kept.setdefault(re.sub(SPACE, " ", t), i)
    shingles = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t, i in kept.items()}
    stay = [i for i in shingles if not any(j < i and 4 * len(shingles[i] & shingles[j]) >= 3 * len(shingles[i] | shingles[j]) for j in shingles)]
    assert set(found) == set(stay)
    clean = sorted(i for i in stay if "token" not in rows[i][0])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(found[i][0][2] == len(library.encode(rows[i][0], add_special_tokens=False).ids) + 1 for i in clean)
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_empty_tables(spark, table):
    folder, _ = table
    for name, query in vars(queries).items():
        if re.match(r"op\d+_", name):
            assert query(spark, f"{folder}/none").count() == 0, name
