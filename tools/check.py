"""Run registered queries against their SQL twins: check.py [sf] [name-part ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from docloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from docloom.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
parts = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session(8)
con = connect(sf_dir)
bad = []
for name, fn in QUERIES.items():
    if parts and not any(p in name for p in parts):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in ORACLES:
            problems = compare(df, con, ORACLES[name])
            note = "; ".join(problems) or "ok"
        else:
            note, problems = f"rows-only {df.count()}", []
    except Exception as exc:
        problems = [str(exc)[:1500]]
        note = "ERROR " + problems[0]
    if problems:
        bad.append(name)
    print(f"{name:34s} {time.time() - t0:6.2f}s  {note}", flush=True)
print("FAILED:", bad)
