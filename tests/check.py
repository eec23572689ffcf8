"""python tests/check.py SF_DIR [names ...]: compares registered queries with their SQL, one line each."""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import differences, duck  # noqa: E402
from conftest import make_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = make_session()
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = differences(df, con, oracles[name]) if name in oracles else ["no SQL"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.2f}s {problems or ''}", flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
