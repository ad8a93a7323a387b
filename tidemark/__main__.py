"""Command line: python -m tidemark --store DIR <command> ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import date, time

from pyspark.sql import functions as F

from . import schemas
from .plans import duplicates, export, rebuild, reports, serve, state, views
from .session import build_session
from .sources import config, labs, manual


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--store", required=True, help="folder of the ledgers and the state")
    p.add_argument("--zone", default="UTC")
    p.add_argument("--priorities", help="YAML: data type -> sources in order")
    p.add_argument("--master", default=None)
    c = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> argparse.ArgumentParser:
        x = c.add_parser(name)
        for names, options in arguments:
            x.add_argument(*names.split(), **options)
        return x

    one = lambda n, **o: (n, o)
    when = (one("--date", help="local; today if there is none"), one("--time", help="local; the present if there is none"), one("--notes"), one("--raw", help="folder of the raw store; below the store if there is none"))
    effort = (one("--focus"), one("--rpe", type=float))
    command("init")
    command("doctor")
    command("import", one("route", choices=rebuild.ROUTES), one("path"), one("--endpoint", default=""), one("--biomarkers", help="YAML: biomarkers: canonical name -> spellings"), one("--staging", help="shared folder that archives are unpacked into"))
    command("preview-labs", one("path"), one("--biomarkers", required=True))
    command("sync", one("source", choices=tuple(rebuild.CONNECTORS)), one("url"), one("--raw", required=True), one("--token-variable", help="environment variable that holds the access token"))
    command("status", one("source"))
    command("source", one("name"), one("state", choices=("enable", "disable")))
    command("event", one("type"), *when, one("--hours", type=float), one("--value", type=float), one("--unit"))
    command("alcohol", one("drinks", type=float), *when)
    command("workout", one("type", choices=schemas.WORKOUT_TYPES), one("minutes", type=int), *when, *effort)
    command("lift", one("minutes", type=int), *when, *effort)
    command("duplicates", one("action", choices=("refresh", "list", "resolve")), one("link", nargs="?"), one("resolution", nargs="?", choices=("confirmed", "rejected")))
    command("coverage")
    command("quality")
    command("analyze", one("--html"))
    command("export", one("folder"), one("--format", default="parquet", choices=("parquet", "csv")))
    command("rebuild", one("raw"), one("--biomarkers"), one("--staging"))
    command("view", one("name", choices=views.VIEWS))
    command("dashboard", one("--days", type=int, default=365, choices=reports.RANGES))
    command("serve", one("--port", type=int, default=8765))
    return p


def biomarkers(path: str | None) -> dict[str, list[str]]:
    return config.load_yaml(path)["biomarkers"] if path else {}


def entered(args) -> tuple[str, dict]:
    """(endpoint, document) of a manual entry."""
    when = {"day": args.date and date.fromisoformat(args.date), "at": args.time and time.fromisoformat(args.time), "notes": args.notes}
    if args.command in ("workout", "lift"):
        kind = "resistance" if args.command == "lift" else args.type
        return manual.WORKOUTS, manual.workout_document(kind, args.minutes, args.zone, focus=args.focus, rpe=args.rpe, **when)
    if args.command == "alcohol":
        return manual.EVENTS, manual.event_document("alcohol", args.zone, value=args.drinks, **when)
    return manual.EVENTS, manual.event_document(args.type, args.zone, hours=args.hours, value=args.value, unit=args.unit, **when)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(master=args.master)
    order = config.priorities(spark, config.load_yaml(args.priorities)) if args.priorities else None
    say = lambda value: print(json.dumps(value, default=str))
    if args.command == "rebuild":
        say(rebuild.totals(rebuild.rebuild(spark, args.raw, args.store, zone=args.zone, biomarkers=biomarkers(args.biomarkers), staging=args.staging, priorities=order)))
        return 0
    store = export.SnapshotStore(spark, args.store)
    if args.command == "init":
        if order is not None:
            state.set_priorities(store, order)
        say({"tables": len(schemas.TABLES), "priorities": store.read("source_priorities").count()})
    elif args.command == "doctor":
        checks = state.doctor(store, order)
        for name, passed, detail in checks:
            print(f"{'PASS' if passed else 'FAIL'} {name}: {detail}")
        return 0 if all(passed for _, passed, _ in checks) else 1
    elif args.command == "import":
        rows = rebuild.normalize(spark, args.route, args.path, zone=args.zone, endpoint=args.endpoint, biomarkers=biomarkers(args.biomarkers), staging=args.staging)
        say(rebuild.ingest(store, rows, args.route.split("_api")[0].split("_export")[0]))
    elif args.command == "preview-labs":
        counts, unknown = labs.preview(labs.normalize(spark, args.path, biomarkers(args.biomarkers), args.zone)["lab_results"])
        say(counts | {"unknown": unknown})
    elif args.command == "sync":
        headers = {"Authorization": f"Bearer {os.environ[args.token_variable]}"} if args.token_variable else {}
        say(rebuild.sync(store, args.raw, args.source, args.url, zone=args.zone, headers=headers))
    elif args.command == "status":
        got = state.sync_status(store, args.source)
        say(got)
        return 0 if got["ok"] else 1
    elif args.command == "source":
        state.enable_source(store, args.name, args.state == "enable")
    elif args.command in ("event", "alcohol", "workout", "lift"):
        say(rebuild.enter(store, args.raw or f"{args.store.rstrip('/')}/raw", *entered(args)))
    elif args.command == "duplicates" and args.action == "refresh":
        say(state.refresh_links(store))
    elif args.command == "duplicates" and args.action == "resolve":
        state.resolve(store, args.link, args.resolution)
    elif args.command == "export":
        say(export.export_datasets(store.ledgers(order), args.folder, kind=args.format))
    elif args.command == "dashboard":
        say(reports.dashboard(store.ledgers(order), store.read("duplicate_links"), store.read("ingestion_runs"), days=args.days))
    elif args.command == "serve":
        serve.server(store, args.port).serve_forever()
    else:
        led = store.ledgers(order)
        if args.command == "duplicates":
            out = duplicates.candidates(store.read("duplicate_links"))
        elif args.command == "coverage":
            out = reports.coverage(reports.ledger_dates(led), F.current_date()).orderBy("metric", "source")
        elif args.command == "quality":
            out = reports.diagnostics(led, store.read("duplicate_links"), store.read("ingestion_runs"))
        elif args.command == "analyze":
            lagged = views.analysis_daily_lagged(views.health_calendar(views.daily_health(led).persist())).persist()
            out = reports.relationship_report(lagged)
            if args.html:
                reports.html_report({n: lagged.select(x, y).dropna() for n, x, y in views.RELATIONSHIPS}, out, args.html)
        else:
            out = views.view(led, args.name)
        for row in reports.to_json_rows(out):
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
