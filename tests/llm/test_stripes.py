"""Stripes and Bloom filters of token files, with row groups as small as ORC allows."""

import random
from pathlib import Path

from pyarrow import orc

from skein.llm import token_files
from tests.llm.test_operators import metrics


def test_filters_on_ids_read_few_rows(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(50 * k, " ".join(str(rnd.randint(0, 9)) for _ in range(30))) for k in range(12_000)]
    path = f"file://{tmp_path}/t"
    token_files.write_token_orc(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, partitions=1, stripe_bytes=128 << 10, row_index_stride=1000)
    (file,) = [f for f in Path(f"{tmp_path}/t").iterdir() if f.name.startswith("part-")]
    assert orc.ORCFile(file).nstripes > 1 and orc.ORCFile(file).nrows == len(rows)
    scanned = lambda ids: next(int(m["value"]) for m in metrics(spark, token_files.read_token_orc(spark, path, ids)) if m["name"] == "number of output rows")
    assert token_files.read_token_orc(spark, path, [50 * 7001]).count() == 1
    assert 1 <= scanned([50 * 7001]) <= 3000  # its row groups, of 12,000 rows
    absent = [50 * k + 1 for k in (1500, 4500, 7500, 10_500)]  # within the statistics' ranges; only Bloom filters tell that they're absent
    assert all(scanned([k]) < 3000 for k in absent) and min(scanned([k]) for k in absent) == 0
