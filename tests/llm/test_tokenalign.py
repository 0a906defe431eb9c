"""Alignment against all pairs of token spans, made in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import queries, tokenalign

FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocabularies():
    return tokenalign.Vocabularies.load(*FILES)


def plain_tokens(text):
    """(id, start, end) of both tokenizers, one text and one token at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    state = plain_tokens.__dict__
    if not state:
        state["a"], state["b"] = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
        state["a"].encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        state["letters"] = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert decoders.ByteLevel().decode(["Ġa"]) == " a"
    if not text:
        return [], []
    whole = " " + text
    sides = []
    ids = state["a"].encode(whole, add_special_tokens=False).ids
    sides.append([(i, bytes(state["letters"][c] for c in state["a"].id_to_token(i))) for i in ids])
    side = []
    for i in state["b"].encode(text):
        piece = state["b"].id_to_piece(i)
        side.append((i, bytes([int(piece[3:5], 16)]) if state["b"].is_byte(i) else piece.replace("▁", " ").encode()))
    sides.append(side)
    if any(b"".join(x for _, x in s) != whole.encode() for s in sides):
        return [], []
    out = []
    for s in sides:
        at, spans = 0, []
        for i, x in s:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain_alignment(rows):
    tokens = [(d, *plain_tokens(t)) for d, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])] for _, a, b in tokens]
    counts = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (d, a, b), found in zip(tokens, links):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            inside = [",".join(str(x[0]) for x in s if low < x[2] <= cut) for s in (a, b)]
            groups.append("|".join(inside))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(cuts), len(found), sum(counts[p] == best[p[1]] for p in found), sum(counts[p] for p in found), digest))
    return sorted(out, key=repr)


def run(spark, vocabularies, rows, **options):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = tokenalign.align(docs, vocabularies, **options)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "plain words and more plain words"), (4, "plain words and more plain words"),
    (None, "no id"), (5, "a ▁ mark of the pieces"), (6, "<|endoftext|> and <s> are text, so is <0x41>"), (7, "漢字 \U0001f600 é \x00 \t\n\n"),
    (8, "word " * 400), (9, "ﬁ   　 trailing  "), (10, "x"), (11, "a" * 700),
]


def test_edge_rows(spark, vocabularies):
    got = run(spark, vocabularies, EDGES)
    assert got == plain_alignment(EDGES)
    assert (5, 0, 0, 0, 0, 0, 0, "") in got


def test_random_texts_in_small_blocks_and_rare_pairs_joined(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(tokenalign, "BLOCK", 300)
    monkeypatch.setattr(tokenalign, "PARTIAL", 200)
    rng = random.Random(5)
    letters = "abcdefgh ijklmno pqrs tuvw xyz \n.,;!?0123456789-_ABCéü漢\U0001f600"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(120)))) for k in range(120)]
    rows += [(k, t) for k, t in EDGES if t and len(t) < 100]
    want = plain_alignment(rows)
    for probed in (1 << 21, 200, 0):
        assert run(spark, vocabularies, rows, probed=probed) == want


def test_long_text(spark, vocabularies):
    rows = [(1, "many words of one long text, " * 60_000), (2, "many words of one long text, ")]
    got = run(spark, vocabularies, rows)
    n_a, n_b = plain_tokens(rows[0][1])
    assert got[0][1:3] == (len(n_a), len(n_b)) and got[0][3] <= len(n_b)


def test_empty_table_and_clashing_columns(spark, vocabularies):
    assert run(spark, vocabularies, []) == []
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, pairs int, row int, links int")
    assert tokenalign.align(docs, vocabularies).count() == 1


def test_registered_query_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 3000).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op11(spark, folder).collect()}
    plain = {r[0]: r for r in plain_alignment(rows)}
    assert len(plain) > 100
    for d, r in plain.items():  # corpus-wide columns need all rows; they are compared above
        mine = got[d]
        assert (mine["n_a"], mine["n_b"], mine["n_groups"], mine["n_links"], mine["groups_sha256"]) == (*r[1:5], r[7])


def test_merging_by_ranks_equals_the_library_of_the_file(vocabularies):
    coder = tokenalign.Encoder(vocabularies)
    assert coder.ranked is not None
    known = [chr(c) for c in (*range(0x280), *range(0x2000, 0x3000))]
    texts = [shape.format(c) for c in known for shape in ("a{0}b", "1{0}2", " {0}{0} x", "{0}'s{0}", "x {0}\n{0}", ".{0}-")]
    assert all(tokenalign.plain_enough(t.encode()) for t in texts)
    library = [e.ids for e in coder.a.encode_batch_fast(texts, add_special_tokens=False)]
    assert [coder.ranked.encode_ordinary(t) for t in texts] == library
    rng = random.Random(2)
    mixed = ["".join(rng.choice(known) for _ in range(40)) for _ in range(2000)]
    assert [coder.ranked.encode_ordinary(t) for t in mixed] == [e.ids for e in coder.a.encode_batch_fast(mixed, add_special_tokens=False)]
    for odd in ("漢", "a" * 300, " " * 300, "\u1e9e", "\U0001f600"):
        assert not tokenalign.plain_enough(odd.encode())
