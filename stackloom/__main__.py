"""``python -m stackloom`` with reconstruct SOURCE OUT, batch OUT SOURCE..., newest OUT, or validate RUN."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from stackloom.plans.run import batch, newest, reconstruct
from stackloom.runtime import session, ship
from stackloom.sources.bundle import validate


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stackloom")
    p.add_argument("--master", default="local[8]")
    sub = p.add_subparsers(dest="do", required=True)
    r = sub.add_parser("reconstruct", help="one image stack to a run folder")
    r.add_argument("source")
    r.add_argument("out")
    r.add_argument("--channel", type=int)
    r.add_argument("--surgery", type=date.fromisoformat)
    r.add_argument("--discard", type=int, default=0)
    r.add_argument("--stride", type=int, default=4)
    b = sub.add_parser("batch", help="several stacks, each to a validated run folder, with a table of their status")
    b.add_argument("out")
    b.add_argument("sources", nargs="+")
    b.add_argument("--channel", type=int)
    b.add_argument("--stride", type=int, default=4)
    n = sub.add_parser("newest", help="the newest run folder of each scan")
    n.add_argument("out")
    v = sub.add_parser("validate", help="all errors of a run folder")
    v.add_argument("run")
    a = p.parse_args(argv)
    spark = session(a.master)
    ship(spark)
    if a.do == "reconstruct":
        print(reconstruct(spark, a.source, a.out, a.channel, a.surgery, discard=a.discard, stride=a.stride))
        return 0
    if a.do == "batch":
        rows = batch(spark, a.sources, a.out, channel=a.channel, stride=a.stride).collect()
        for r in rows:
            print(r["status"], r["source"], r["run"] or r["message"])
        return 0 if all(r["status"] == "pass" for r in rows) else 1
    if a.do == "newest":
        for r in newest(spark, a.out).orderBy("scan").collect():
            print(r["run"])
        return 0
    errors = validate(spark, a.run).orderBy("path", "error").collect()
    for e in errors:
        print(f"{e['path']}: {e['error']}")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
