"""Command line of the library: scan, dedup, analyze, similar, bestshot, report, organize."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import places
from .config import Config
from .operators import organize, reports
from .plans import actions, library
from .sources.sinks import export
from .sources.store import Store


def session() -> SparkSession:
    return SparkSession.builder.appName("shoebox").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _scan(args, store) -> int:
    if not os.path.isdir(args.path):
        print(f"no such folder: {args.path}", file=sys.stderr)
        return 2
    got = library.scan(store, args.path, args.detect_deletions)
    print(f"new {got['new']:,} · updated {got['updated']:,} · unchanged {got['unchanged']:,}" + (f" · deleted {got['deleted']:,}" if got["deleted"] is not None else ""))
    if args.detect_deletions and got["deleted"] is None:
        print("warning: no file was seen, so none was marked as deleted")
    return 0


def _dedup(args, store) -> int:
    from .operators.dedup import redundant

    row = redundant(library.find_duplicates(store, not args.no_prefilter, args.workers)).first()
    print(f"groups {row['groups']:,} · redundant files {row['redundant']:,}")
    return 0


def _analyze(args, store) -> int:
    ok, errors = library.analyze(store, args.thumb_dir, Config.load(args.config), workers=args.workers)
    print(f"ok {ok:,} · errors {errors:,}")
    for r in reports.category_counts(store.read("files")).toLocalIterator():
        print(f"  {r['category']} {r['n']:,}")
    return 0


def _similar(args, store) -> int:
    cfg = Config.load(args.config)
    if args.threshold is not None:
        cfg = Config.from_dict({**cfg.to_dict(), "hamming_threshold": args.threshold})
    row = reports.members_total(library.find_similar(store, cfg)).first()
    print(f"groups {row['groups']:,} · members {row['members']:,}")
    return 0


def _bestshot(args, store) -> int:
    print(f"groups {library.choose_best(store, args.preset, Config.load(args.config)):,}")
    return 0


# For each report its title, the head of a group, the marks of a kept and of another item.
TITLES = {"dup": "완전중복", "similar": "유사그룹", "actions": "작업 이력"}
HEADS = {"dup": "중복", "similar": "유사"}
MARKS = {"dup": ("★ 대표", "  중복"), "similar": ("⭐ 베스트", "        ")}


def _line(name: str, r) -> str:
    if name == "dup":
        return f"{MARKS[name][not r['is_representative']]}  {r['path']}"
    if name == "similar":
        kind = f" [{r['category']}]" if r["category"] else ""
        return f"{MARKS[name][not r['is_best_shot']]} 유사도 {r['similarity_score']:.3f}{kind}  {os.path.basename(r['path'])}" + (f"  ({r['reason']})" if r["reason"] else "")
    return f"{r['timestamp']}  {r['action']}  #{r['batch']}{' ' + r['undone'] if r['undone'] else ''}  {r['from_path']}" + (f" → {r['to_path']}" if r["to_path"] else "")


def _show(name: str, rows) -> None:
    """K-16: groups under heads of their own, then how many there were. Rows come in the report's order, one partition at a time."""
    group, groups, n = None, 0, 0
    for r in rows.toLocalIterator():
        if name in HEADS and r["group_id"] != group:
            group, groups = r["group_id"], groups + 1
            print(f"\n[{HEADS[name]} {group}]" + (f" size={r['size']:,}  hash={r['content_hash'][:12]}…" if name == "dup" else ""))
        print("  " + _line(name, r))
        n += 1
    print(f"{TITLES[name]}: {groups:,} groups, {n:,} rows" if name in HEADS else f"{TITLES[name]}: {n:,} rows")


def _report(args, store) -> int:
    tables = {
        "dup": lambda: reports.duplicate_report(store.read("duplicate_groups"), store.read("files")),
        "similar": lambda: reports.similar_report(store.read("similar_groups"), store.read("files")),
        "actions": lambda: reports.action_report(store.read("action_log")),
    }
    if not (args.csv or args.json):  # the reasons are for reading, not for the files
        tables["similar"] = lambda: reports.similar_listing(store.read("similar_groups"), store.read("files"))
    path, kind = (args.csv, "csv") if args.csv else (args.json, "json")
    if path:
        if args.kind == "all":
            print("choose one --kind to write a file", file=sys.stderr)
            return 2
        print(f"{export(tables[args.kind](), path, kind):,} rows to {path}")
        return 0
    for name in tables if args.kind == "all" else [args.kind]:
        _show(name, tables[name]())
    print(f"files {reports.count_active(store.read('files')).first()['n']:,}")
    return 0


def _organize(args, store) -> int:
    plan = actions.organize_plan(store, args.dest, args.unknown_dir)
    if plan.isEmpty():
        print("nothing to organise: scan and analyze first")
        return 0
    if args.apply:
        moved, skipped, failed, stale = actions.apply_plan(store, plan)
        print(f"moved {moved:,} · skipped {skipped:,} · failed {failed:,}" + (f" · stale {stale:,}" if stale else ""))
        return 0
    for r in organize.by_source(plan).toLocalIterator():
        print(f"  {r['source']} {r['n']:,}")
    t = organize.totals(plan).first()
    print(f"  to move {t['to_move']:,} · in place {t['in_place']:,}")
    for r in organize.months(plan).toLocalIterator():
        print(f"    {r['month']} {r['n']:,}")
    for r in organize.samples(plan).toLocalIterator():
        print(f"    {r['name']} → {os.path.relpath(r['dest_dir'], os.path.abspath(args.dest))}")
    return 0


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shoebox")
    p.add_argument("--store", default=places.store_dir(), help="folder of the library's tables")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for names, kw in options:
            c.add_argument(*names, **kw)

    config, workers = (("--config",), {}), (("--workers",), {"type": int, "help": "tasks that read files; as many as Spark makes if not given"})
    command("scan", _scan, (("path",), {}), (("--detect-deletions",), {"action": "store_true"}))
    command("dedup", _dedup, workers, (("--no-prefilter",), {"action": "store_true"}))
    command("analyze", _analyze, workers, (("--thumb-dir",), {"default": places.thumb_dir()}), config)
    command("similar", _similar, (("--threshold",), {"type": int}), config)
    command("bestshot", _bestshot, (("--preset",), {"choices": ["person", "landscape"]}), config)
    command("report", _report, (("--kind",), {"choices": ["dup", "similar", "actions", "all"], "default": "all"}), (("--csv",), {}), (("--json",), {}))
    command("organize", _organize, (("--dest",), {"required": True}), (("--apply",), {"action": "store_true"}), (("--unknown-dir",), {"default": organize.UNKNOWN_FOLDER}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    return args.run(args, Store(spark or session(), os.path.abspath(args.store)))


if __name__ == "__main__":
    sys.exit(main())
