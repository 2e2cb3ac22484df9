"""The pipeline against plain functions, stage by stage, on a small corpus."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, credentials, order_minhash


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(11)
    stems = {"aa": ["thor", "ing", "ed", "whe", "oun"], "bb": ["eau", "ment", "oir", "que", "çon"]}
    text = lambda lang, n=60: " ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(2, 4))) for _ in range(n))
    items = [(i, text("aa", 20)) for i in range(3)]
    rows = [(i, text(lang), lang, "s", 1) for i, lang in enumerate(rnd.choices(list(stems), k=120))]
    near = [(200 + i, rows[i][1].replace("thor", "thor", 1) + " end", rows[i][2], "s", 1) for i in range(10)]
    leaks = [(300 + i, text("aa") + " " + items[i][1], "aa", "s", 1) for i in range(3)]
    hidden = [(400, text("bb") + " token = abcdefghijklmnopqrst " + text("bb"), "bb", "s", 1)]
    junk = [(500, "12 34", "aa", "s", 1), (501, None, "aa", "s", 1)]
    docs = rows + near + leaks + hidden + junk
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, hidden


def test_run(spark, case):
    folder, rows, hidden = case
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {r[0] for r in rows} | {400}
    codec = bpe.BytePairCodec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for i, text, *_ in [*rows, *hidden]:
        text = credentials.redacted(text, credentials.scan(text)[1])
        ids = library.encode_ordinary(text)
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, case):
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, case[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), case[0]).count() == 0


def test_near_copies_of_a_passage_that_many_texts_share(spark):
    """One document of each family in a bucket of more than FINE, whose smallest node is unlike all of them."""
    rnd = random.Random(15)
    word = lambda: f"t{rnd.randrange(5000)}"
    shared = [word() for _ in range(75)]
    rows = [(0, " ".join(shared + [word() for _ in range(25)]))]
    for _ in range(24):
        family = [word() for _ in range(25)]
        for _ in range(5):
            own = list(family)
            for k in rnd.sample(range(25), 8):
                own[k] = word()
            rows.append((len(rows), " ".join(shared + own)))
    codes = [np.array([int(w[1:]) for w in t.split()], np.uint32) for _, t in rows]
    links = [(b, a) for a in range(len(rows)) for b in range(a) if order_minhash.similar(codes[a], codes[b])]
    parent = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    batch_rows = spark.conf.get(corpus_pipeline._BATCH)
    try:
        kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    finally:
        spark.conf.set(corpus_pipeline._BATCH, batch_rows)
    assert sorted(r.doc_id for r in kept) == sorted(set(parent))
