"""Print the formatted physical plan of registered queries (pushdown, exchanges, joins).

usage: python tools/explain_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")]
    from tidepanel import queries as Q
    from tidepanel.session import get_spark
    spark = get_spark("local[8]", 16)
    for n in names:
        print(f"===== {n}")
        Q.QUERIES[n](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
