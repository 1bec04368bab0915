"""Commands (Q21): python -m lodestone COMMAND --store URI [--root URI] ...

start-init scans a tree, sync-changes and audit-changes follow it, reindex-apis makes the endpoints anew;
impact, search, ontology, rules and contract ask; design-sync and design-audit are for design sources,
design-bindings NAME FRAMEWORK generates bindings, workspace lists the repositories of a folder.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _show(df: DataFrame, limit: int) -> None:
    for row in df.limit(limit).toJSON().toLocalIterator():
        print(row)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    from lodestone.plans import knowledge as K
    from lodestone.plans.api import Engine
    from lodestone.session import local_session
    from lodestone.sources import files as files_
    from lodestone.sources.store import Store, write_documents

    p = argparse.ArgumentParser("lodestone", description=__doc__)
    names = ("start-init", "sync-changes", "audit-changes", "reindex-apis", "impact", "search", "ontology", "rules", "contract", "design-sync", "design-audit", "design-bindings", "workspace")
    p.add_argument("command", choices=names)
    p.add_argument("words", nargs="*")
    p.add_argument("--store", required=True)
    p.add_argument("--root")
    p.add_argument("--since")
    p.add_argument("--paths", nargs="*", default=[])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--full", action="store_true", help="start anew whatever the store holds")
    p.add_argument("--docs", help="a folder for Markdown documents")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    spark = spark or local_session("*")
    engine = Engine(Store(spark, a.store))
    if a.command in ("start-init", "sync-changes", "audit-changes", "design-sync", "design-audit", "workspace") and not a.root:
        p.error(f"{a.command} needs --root")
    if a.command == "start-init":
        if a.full or not engine.store.exists("snapshot"):
            K.start_init(spark, a.root, a.store)
        else:
            _show(engine.sync_arch_changes(a.root), a.limit)
        if a.docs:
            write_documents(K.documents(engine.store), a.docs, lambda row: row["path"])
    elif a.command == "sync-changes":
        _show(engine.sync_arch_changes(a.root, dry_run=a.dry_run, since=a.since, paths=a.paths), a.limit)
    elif a.command == "audit-changes":
        _show(engine.audit_arch_changes(a.root, a.since, a.paths), a.limit)
    elif a.command == "reindex-apis":
        engine.reindex_apis()
    elif a.command == "impact":
        got = engine.query_impact(a.words[0])
        print(json.dumps({"notes": got["notes"]}))
        for part in ("layers", "relations", "callers", "callees", "used_by", "references"):
            _show(got[part], a.limit)
    elif a.command == "search":
        _show(engine.search_arch(" ".join(a.words), a.limit), a.limit)
    elif a.command == "ontology":
        _show(engine.query_ontology(" ".join(a.words) or None), a.limit)
    elif a.command == "rules":
        _show(engine.query_path_rules(), a.limit)
    elif a.command == "contract":
        _show(engine.query_contract(a.words[0]), a.limit)
    elif a.command == "design-sync":
        engine.design_sync(files_.scan(spark, a.root), a.dry_run)
    elif a.command == "design-audit":
        _show(engine.audit_design_changes(files_.scan(spark, a.root), a.paths), a.limit)
    elif a.command == "design-bindings":
        _show(engine.generate_bindings(a.words[0], a.words[1], a.dry_run), a.limit)
    elif a.command == "workspace":
        _show(files_.init_workspace(files_.scan(spark, a.root), engine.store), a.limit)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
