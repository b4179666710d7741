"""Run registered queries against their twins: `python tests/check.py [folder] [name ...]`."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from capture_analytics import build_session  # noqa: E402
from capture_analytics.plans import PLANS, TWINS  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
wanted = sys.argv[2:]
spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = 0
for name, plan in PLANS.items():
    if wanted and not any(w in name for w in wanted):
        continue
    started = time.time()
    try:
        if name in TWINS:
            verdict = compare(plan, TWINS[name], spark, folder, con)
        else:
            verdict = f"no twin, {plan(spark, folder).count()} rows"
            print(f"  -- {name}: {verdict} {time.time() - started:.1f}s", flush=True)
            continue
    except Exception as e:  # noqa: BLE001
        verdict = f"{type(e).__name__}: {str(e)[:700]}"
    bad += verdict is not None
    print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {verdict or ''} {time.time() - started:.1f}s",
          flush=True)
print("failed:", bad)
