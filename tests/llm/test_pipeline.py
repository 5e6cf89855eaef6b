"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline as pipeline
from evidencelake.llm import pieces


def prose(seed, words=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ren", "tas", "vo"]) for _ in range(r.randrange(1, 4))) for _ in range(words))


def tables(spark, folder):
    texts = {i: prose(i) for i in range(60)}
    for i in range(0, 60, 3):
        texts[i] = texts[i] + " grumbly grumbly snarkish"
    texts[70] = texts[1]
    texts[71] = texts[2] + " more"
    texts[72] = prose(72, 40) + " " + prose(500, 20) + " " + prose(73, 40)
    rows = [(i, t, "xx" if i % 2 else None, f"s{i % 3}", len(t)) for i, t in texts.items()] + [(80, None, None, None, None), (81, "", "xx", None, 0), (82, "12 34", "xx", None, 5), (None, prose(90), "xx", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(500, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages_drop_what_is_planted_and_keep_the_rest(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts = tables(spark, folder)
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns or name == "tokens"
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i in range(60) if i % 3}
    assert left[0] == clean | {70, 71, 72, 80, 81, 82, None}
    assert left[1] == clean | {70, 71, 72, None}
    assert left[2] == clean | {72, None}
    assert left[3] == left[4] == clean | {None}
    coder = pieces.Coder(pieces.Vocabulary.load(pipeline.vocabulary_path()))
    for r in docs.where("doc_id IS NOT NULL").collect():
        assert coder.decode(r["tokens"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["tokens"])
    assert {r["doc_id"] for r in pipeline.run(spark, folder).collect()} == left[4]


def test_repeated_rows_leave_one(spark, tmp_path):
    rows = spark.createDataFrame([(5, prose(1)), (5, prose(1)), (6, prose(1)), (7, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, rows, "").orderBy("doc_id").collect()] == [5, 7]
