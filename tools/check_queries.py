"""Run the registered queries and compare them with their SQL.

    python tools/check_queries.py [sf_dir] [name ...]
"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pageloom import queries  # noqa: E402
from pageloom.queries.compare import differences, duckdb_views  # noqa: E402
from pageloom.session import local_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    queries.load_all()
    spark = local_session("check")
    db = duckdb_views(sf)
    bad = 0
    for name, fn in queries.QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in queries.SQL:
                wrong = differences(df, db, queries.SQL[name])
                n = df.count()
            else:
                n, wrong = len(df.collect()), []
        except Exception:
            n, wrong = 0, [traceback.format_exc(limit=-4)[:2500]]
        bad += bool(wrong) or n == 0
        kind = "sql " if name in queries.SQL else "rows"
        state = "BAD" if wrong else "EMPTY" if n == 0 else "ok"
        print(f"{state:5s} {kind} {time.time() - start:6.2f}s {n:7d} {name}", flush=True)
        for line in wrong:
            print("      ", line)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]) > 0)
