"""The pipeline against its stages applied by brute force to a small set of documents."""

import corpus_pipeline
from tabulon.llm import packing


def test_stages_take_effect(spark, tmp_path):
    good = [" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(8)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(good)]
    rows += [(20, good[0], "en", "s0", 1), (21, "too short.", "en", "s1", 1), (22, good[1] + "\nHome | About | Contact | Help", "en", "s1", 1), (23, "\n".join(["a | b | c | d"] * 9), "en", "s0", 1)]
    near = good[2].split()
    near[5] = "changed"
    rows += [(24, " ".join(near) + "\n" + " ".join(f"own{j}y" for j in range(30)) + ".", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        seen = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        kept[name] = {r["doc_id"]: r for r in seen.collect()}
    assert sorted(kept["quality rules"]) == [*range(8), 20, 22, 24] and kept["quality rules"][22]["text"] == good[1]
    assert sorted(kept["line dedup"]) == [*range(8), 24] and kept["line dedup"][24]["text"].startswith("own0y")
    assert sorted(kept["n-gram Jaccard join"]) == [*range(8), 24]
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, packing.pack(mixed).collect()))
