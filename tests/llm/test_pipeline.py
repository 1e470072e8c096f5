"""The corpus pipeline, stage by stage, on planted documents; and the queries' SQL."""

import random
import re

import corpus_pipeline


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def test_stages_on_planted_documents(spark, tmp_path):
    draw = random.Random(9)
    clean = [words(draw, 120) for _ in range(12)]
    item, passage = words(draw, 40), words(draw, 60)
    near = clean[0].split(" ")
    near[5] = "changed"
    texts = clean + [clean[1], " ".join(near), "short one", "same old eight words of text here again " * 9, item + " " + words(draw, 50)]
    texts += [words(draw, 60) + " " + passage + " " + words(draw, 60) for _ in range(2)] + [None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    n = len(clean)
    assert set(kept["quality_rules"]) == {*range(n), n, n + 1, n + 4, n + 5, n + 6}
    assert set(kept["near_dedup"]) == {*range(n), n + 4, n + 5, n + 6}
    cut = kept["suffix_dedup"]
    assert set(cut) == set(kept["near_dedup"])
    assert all(cut[i]["text"] == clean[i] for i in range(n))
    assert all(passage[5:-5] not in cut[i]["text"] and cut[i]["n_chars"] == len(cut[i]["text"]) for i in (n + 5, n + 6))
    assert set(kept["decontamination"]) == {*range(n), n + 5, n + 6}
    last = kept["bpe_codec"]
    assert set(last) == set(kept["decontamination"]) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in last.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids_sha256"] for r in whole.collect()} == {i: r["ids_sha256"] for i, r in last.items()}


def test_nothing_outside_reads_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "textveil"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"textveil\.llm|corpus_pipeline", path.read_text()), path
