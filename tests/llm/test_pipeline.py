from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import plain
import public_tokenizers
import pytest
import tiktoken

from stratascope.llm import byte_bpe, mixing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, repeated lines, near copies, rows alike, rows of one id, null and empty texts and ids."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5)))
    vocabulary, bad = [word() for _ in range(600)], ["vile", "filthy", "rotten", "wretched"]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [sentence(9) for _ in range(5)]
    rows = []
    for i in range(180):
        lines = [sentence(rnd.randrange(6, 14)) for _ in range(rnd.randrange(1, 5))]
        if i % 5 == 1:
            lines.insert(1, f"you {' '.join(rnd.choice(bad) for _ in range(5))} {word()}")
        if i % 4 == 0:
            line = rnd.choice(shared)
            lines.insert(rnd.randrange(2), line if i % 8 else line[:-1] + "x")
        if i % 6 == 2:
            lines.append("ok")
        rows.append((i, "\n".join(lines), rnd.choice(["en", None]), rnd.choice(["a", "b", "c", None])))
    for i in (3, 7, 13):  # near copies, of one line so that lines differ by more than two edits
        text = sentence(60)
        rows += [(200 + i, text, "en", "a"), (220 + i, f"{sentence(2)} {text}", "en", "b"), (240 + i, f"{text} {sentence(3)}", "en", "c")]
    rows += [(300, None, "en", "a"), (301, "", "en", "b"), (None, sentence(12), "en", "c"), (302, sentence(15), "en", "a"), (302, sentence(15), None, "a")]
    rows += [rows[0], rows[0], (303, sentence(3000), "en", "d")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, None if i % 7 == 0 else 1, int(i % 5 == 1)) for i in range(170)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_against_plain_version(spark, folder):
    import corpus_pipeline as cp
    from stratascope.llm import queries

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in cp.run(spark, folder).collect())
    # the first stage's scores have a plain version of their own
    scored = toxicity.toxic_scores(docs, queries.toxicity_model(spark, docs, folder)).collect()
    toxic = {r["doc_id"] for r in scored if r["predicted"]}
    assert {i for i in range(180) if i % 5 == 1} == toxic
    rows = [tuple(r) for r in docs.collect() if r["doc_id"] not in toxic]
    after_lines = plain.without_repeats(rows)
    assert len(after_lines) <= len(rows) and sum(r[4] for r in after_lines) < sum(r[4] for r in rows)
    unique = plain.near_unique(after_lines)
    assert len(unique) < len(after_lines)
    frame = duckdb.from_arrow(spark.createDataFrame(unique, docs.schema).toArrow())  # noqa: F841
    mix = duckdb.sql(f"WITH {mixing.MIX_SQL.format(docs='frame')} SELECT doc_id, text, n_ FROM mixed_").fetchall()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want: Counter = Counter()
    for doc_id, text, n in mix:
        ids = library.encode_ordinary(text or "")
        if n:
            want[(doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode()), tuple(ids))] += n
    assert got == want


def test_stages_of_odd_and_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
