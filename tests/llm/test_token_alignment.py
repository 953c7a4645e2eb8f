"""Cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rungwork.llm import token_alignment
from rungwork.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def tokens(text):
    """Rows (id, bytes) of both sides, or none."""
    if not text:
        return [], []
    letters = token_alignment.byte_letters()
    left = Tokenizer.from_file(A) if not hasattr(tokens, "a") else tokens.a
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B) if not hasattr(tokens, "b") else tokens.b
    tokens.a, tokens.b = left, right
    a = [(i, bytes(letters[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()) for i in right.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(row):
    out, at = [], 0
    for i, x in row:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    rows = []
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        ends = sorted({e for *_, e in a} & {f for *_, f in b})
        written = ";".join(
            "|".join(",".join(str(i) for i, _, e in side if first < e <= last) for side in (a, b)) for first, last in zip([0, *ends], ends)
        )
        rows.append((len(a), len(b), len(ends), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    held = Counter(pair for _, _, _, links, _ in rows for pair in set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    return [(a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), d) for a, b, g, links, d in rows]


def texts(seed=1):
    r = random.Random(seed)
    letters = "aaab  \n\té½Ⅷ漢字🙂'srevelmd_1234.-  <>|/"
    odd = [None, "", " ", "  two", "\n", "<|endoftext|>", "<s> </s> <unk> <0x41>", "▁a ▁", "ﬁ ½ ①", " x", "é", "\x00a", "\x1c\x85", "a" * 3000, "ab " * 1500, "🙂" * 50]
    return odd + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(150)] + ["the cat sat on the mat"] * 3


@pytest.mark.parametrize("pairs", [1_000_000, 10])  # counts by broadcast, and by the salted join
def test_columns_equal_brute_force(spark, pairs):
    rows = [(k, t, k, f"x{k}") for k, t in enumerate(texts())]
    rows += [(3, "the cat", 3, "row"), (None, "the cat", 0, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row long, kept string").repartition(4)
    got = token_alignment.aligned_documents(frame, A, B, pairs=pairs).collect()
    want = brute([t for _, t, _, _ in rows])
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, [(x.doc_id, x.row, x.kept, *[x[c] for c in columns]) for x in got])) == sorted(str((i, n, k, *w)) for (i, _, n, k), w in zip(rows, want))
    assert any(w[6] == "" and rows[k][1] for k, w in enumerate(want))  # a text that a side does not give back


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars < 1500").collect()
    got = {x.doc_id: x for x in QUERIES["op12_token_alignment"][0](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d in docs:
        a, b = map(spans, tokens(d.text))
        x = got[d.doc_id]
        assert (x.n_a, x.n_b, x.n_links) == (len(a), len(b), sum(max(s, t) < min(e, f) for _, s, e in a for _, t, f in b))


def test_small_batches_and_empty_tables(spark):
    some = texts(2)
    a, b = token_alignment.sides(A, B)
    whole = token_alignment.Aligned(some, a, b)
    written = dict(zip(whole.which, whole.written_groups(a, b)))
    for first, last in token_alignment.text_groups(some, 40):
        part = token_alignment.Aligned(some[first:last], a, b)
        assert [written[first + i] for i in part.which] == part.written_groups(a, b)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.aligned_documents(empty, A, B).count() == 0
    assert token_alignment.aligned_documents(empty.select("text"), A, B).columns[0] == "n_a"
    with pytest.raises(ValueError):
        token_alignment.aligned_documents(empty.selectExpr("*", "1 AS N_Best"), A, B)
