"""Each stage of the pipeline against a plain statement of it, on its own input, and the whole."""

import re
from collections import defaultdict

from test_operators import SCHEMA, WORDS, awkward, check_pieces, near_plain

import corpus_pipeline
from speechjobs.llm import packing


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(awkward(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = {"documents": spark.read.parquet(f"{tmp_path}/documents.parquet")}
    previous = "documents"
    for name, stage in stages:
        stage(spark, kept[previous], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or kept[name].columns == docs.columns
        previous = name
    rows = {n: [(r["doc_id"], r["text"]) for r in d.collect()] for n, d in kept.items() if n != "packing"}
    assert all(any(map(str.isalpha, t)) for _, t in rows["language_id"])
    lost = set(rows["documents"]) - set(rows["language_id"])
    assert {i for i, t in lost if any(map(str.isalpha, t or ""))} == set()
    groups = defaultdict(list)
    for i, t in rows["language_id"]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    order = lambda i: (i is None, i or 0)
    assert sorted((i for i, _ in rows["exact_dedup"]), key=order) == sorted((min(g, key=order) for g in groups.values()), key=order)
    last = 1 << 62
    near = near_plain([(last if i is None else i, t) for i, t in rows["exact_dedup"]], 5, 80)
    # rows without an id share one fate, so only the others can be told apart by it
    assert sorted(i for i, _ in rows["near_dedup"] if i is not None) == sorted(i for i, _, c in near if i == c != last)
    tokens = lambda part: sum(len(WORDS.findall(t)) for _, t in part)
    assert set(rows["mixing"]) <= set(rows["near_dedup"]) and len(set(rows["mixing"])) == len(rows["mixing"])
    assert tokens(rows["mixing"]) >= int(0.8 * tokens(rows["near_dedup"])) - 40
    pieces = kept["packing"].collect()
    check_pieces(pieces, rows["mixing"], Tokenizer.from_file(packing.vocabulary()[0]))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])
    pick = lambda part: [(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(part, key=key)]
    assert pick(whole.collect()) == pick(pieces)
