"""Line dedup where rows share an id but not the text."""
from __future__ import annotations

from wattlane.llm import lines


def test_rows_of_one_id_and_two_texts(spark):
    same = "a line that stands in three documents, word for word"
    docs = [(1, same), (2, f"an opening of its own, told once\n{same}"), (2, f"quite another text that nobody repeats\nand a second clean line of it"),
            (3, "one line of two texts that share the id"), (3, "one line of two texts that share the id\ntail of the other text")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = sorted((r.doc_id, x) for r in lines.without_repeats(table).collect() for x in r.text.split("\n"))
    assert out == sorted({(i, x) for i, t in docs for x in t.split("\n")} - {(2, same)})
    assert sorted((r.doc_id, r.n_lines) for r in lines.report(table).collect()) == [(1, 1), (2, 2), (2, 2), (3, 1), (3, 2)]
