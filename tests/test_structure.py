"""Queries over lines of documents against plain Python."""

import re

from linkloom.plans import structure as S
from tests.conftest import rows

NUMBER = re.compile(r"\b(\d+(?:\.\d+){0,4})\b")
LINES = ["6.3 Statistical Methods", "siehe § 3.1.2 für Größe", "L’étude « 4.2 » du résumé", "第5.4に示すとおり", "5.4 に示す", "10² and 7", "é4 a5 6", "x " * 60 + "14.2.1.3.9.8", "３.２ 12", "no number", "v1.2 §2.1", "_3 4_ 5"]


def test_first_number_of_every_line(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(LINES)), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = sorted((1, i, m.group(1)) for i, t in enumerate(LINES) if (m := NUMBER.search(t)))
    assert rows(S.anc_06_first_number(spark, str(tmp_path)).select("doc_id", "line_no", "num")) == want and len(want) > 8
