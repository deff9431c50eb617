"""op11_prefix_trie, op12_variants and op13_token_counts against brute force and, where there is one, their SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import prefix_trie, queries, token_counts, variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TURNS = "conv_id long, turn long, role string, text string, name string, depth int, `a.b` int"
DOCS = "doc_id long, text string, word string, n int, content binary"


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = collections.defaultdict(list, {c: [x[2:] for x in sorted(own)] for c, own in convs.items()})
    members, ends, children = (collections.defaultdict(list) for _ in range(3))
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(convs.get(c - c % 100, [])[:h] + convs[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in children[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        total[p] = (sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below))
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((len(p), members[p][0], members[p[:-1]][0] if p else -1, len(members[p]), len(children[p]), *total[p], sha(p)) for p in members)


def rows_of_trie(df):
    return sorted((r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(100, 230), 301, 305, 4000]:  # the hundred of 301 has no base
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 33])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é𝒳"]), "clash", 7, 1))
    rows += [(7, 5, "user", "twice", "x", 1, 1)] * 2 + [(None, 0, "user", "lost", "x", 1, 1), (12, 1, "user", "long " * 60_000, "x", 1, 1)]
    rows += [(9, t, "user", f"t{t}", "x", 1, 1) for t in range(300)] + [(9 + 100, t, "user", f"t{t}", "x", 1, 1) for t in range(290)]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    got = prefix_trie.prefix_trie(df)
    assert rows_of_trie(got) == brute_trie([r[:4] for r in rows])
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


def test_trie_of_equal_conversations(spark):
    """Thousands end at one node: their ids are joined by ranges, and hashed in order."""
    n = 5000
    df = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    assert rows_of_trie(prefix_trie.prefix_trie(df)) == brute_trie([(c, 0, "user", "hi") for c in range(n)])


def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    nears = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: min(os, key=lambda o: (-words[o], o)) for w, os in nears.items() if os}
    form = {w: o for w, o in form.items() if words[o] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w, ""), root, n, len(nears[w]), words[form[w]] if w in form else -1))
    return sorted(out)


def rows_of_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["straße", "Straße", "STRASSE", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 500, "x" * 501, "x" * 250 + "y" + "x" * 249, "a×b÷cc", "ÀÉàé"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "1\n"])) for i in range(300)]
    rows += [(None, "aaaaaaa aaaaaaaa"), (3, None), (4, ""), (4, ""), (5, "aaaaa " * 9000), (6, " \n ")]
    rows += [(7, "plonkee " * 3 + "plonkea " * 8 + "plonkia " * 20)]
    df = spark.createDataFrame([(*r, "w", 1, b"c") for r in rows], DOCS).repartition(5)
    want = brute_variants(rows)
    assert rows_of_variants(variants.variants(df)) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert variants.variants(df.where("false")).count() == 0
    assert variants.variants(df.where(F.trim("text") == "")).count() == 0


def test_variants_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, " ".join(f"{a}bcd{b}" for a in "pqrs" for b in "efgh")) for i in range(4)]
    monkeypatch.setattr(variants, "EDGES", 0)
    monkeypatch.setattr(variants, "HELD", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of_variants(variants.variants(df)) == brute_variants(rows)


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return token_counts.pieces(public_tokenizers.path("piece_bpe_32k.model")), token_counts.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "a", "a", "two  spaces <s> </s> <unk>", "é𝒳 ﬁ \t\n x", "▁ ▁▁a", None, "word " * 5000, " lead", "trail ", "12345 !!"]


def test_token_counts_equal_the_library(spark, tokenizers, tmp_path):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i if i % 5 else None, t, "w", 1, b"c") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted((str(i), len((t or "").encode()), len(own.encode(t or "")), len(own.encode(t or "")) > 4096) for i, t, *_ in rows)
    cache = str(tmp_path / "store")
    counted = lambda d: sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(d, tokenizers[0], cache).collect())
    assert counted(df) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    assert counted(df) == want and spark.read.parquet(cache).count() == stored.count()  # all hits: nothing is added
    more = df.unionByName(spark.createDataFrame([(99, "a new text", "w", 1, b"c")], DOCS))
    assert len(counted(more)) == len(want) + 1 and spark.read.parquet(cache).count() == stored.count() + 1
    spark.read.parquet(cache).limit(3).write.mode("append").partitionBy("tokenizer").parquet(cache)  # as two runs at a time would
    assert counted(df) == want
    assert token_counts.token_counts(df.where("false"), tokenizers[0], cache).count() == 0


def test_token_counts_take_stored_counts_of_this_tokenizer_only(spark, tokenizers, tmp_path):
    cache, df = str(tmp_path / "store"), spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    first = token_counts.token_counts(df, tokenizers[0], cache).first().n_tokens
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(777).cast("long")).write.partitionBy("tokenizer").parquet(f"{cache}-2")
    assert token_counts.token_counts(df, tokenizers[0], f"{cache}-2").first().n_tokens == 777
    other = token_counts.token_counts(df, tokenizers[1], f"{cache}-2").first().n_tokens
    assert other == 3 and first != 777


def test_token_counts_of_many_missing_texts(spark, tokenizers, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "MISSING", 0)
    df = spark.createDataFrame([(i, TEXTS[i % 4]) for i in range(20)], "doc_id long, text string")
    assert token_counts.token_counts(df, tokenizers[0], str(tmp_path / "store")).count() == 20
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_long_texts_count_the_same_in_parts(tokenizers):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=tokenizers[0].data)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "the", " ", "  ", "\n", "é", "▁", "x" * 30]) for _ in range(400)) for _ in range(60)]
    for most in (1, 7, 50):
        assert token_counts._piece_encoder(tokenizers[0].data, most)(texts) == [len(own.encode(t)) for t in texts]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in found.collect()) == want
