"""Executors that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path alone: workers don't inherit it
from lendscope.llm import decontamination, language_model, line_quality, pii, quality_rules, toxicity
from lendscope.llm.common import crc_mod
from lendscope.session import build_session
from pyspark.sql import functions as F

spark = build_session("local[2]", shuffle_partitions=2)

def missing(batches):
    import importlib.util
    for b in batches:
        found = importlib.util.find_spec("lendscope") is not None
        yield b.set_column(0, "id", __import__("pyarrow").array([int(found)] * b.num_rows, "int64"))

assert spark.range(4).mapInArrow(missing, "id long").agg(F.sum("id")).first()[0] == 0  # before anything is shipped
text = "mail someone{{0}}@example{{0}}.com or +1 (499) 555-6503 now, a plain line of words that goes on here."
docs = spark.createDataFrame([(i, text.format(i) + " " + ("idiot " if i % 2 else "friend ") * 3, "s") for i in range(60)], "doc_id long, text string, source string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
items = spark.createDataFrame([(1, text.format(3))], "item_id long, text string")
held = crc_mod("doc_id", 5) == 0
frames = [pii.personal_data(docs, pii.fit(docs)), toxicity.toxicity(docs, toxicity.fit(docs, labels, ~held), held), quality_rules.rules(docs, quality_rules.fit(docs, labels)),
          decontamination.contaminated(docs, items), line_quality.quality(docs, line_quality.fit(docs, labels, ~held), held), language_model.scored(docs, held)]
print("rows", [f.count() for f in frames])
"""


def test_models_reach_executors_without_the_package(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], capture_output=True, text=True, cwd=tmp_path, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert "rows [60, 60, 60, 60, 60, 60]" in run.stdout
