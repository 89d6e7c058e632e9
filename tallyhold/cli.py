"""Command line: scan, status, dupes, locate, orphans, restore, check, gc, key."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tallyhold.errors import ConfigError, InventoryError, NotFoundError
from tallyhold.functions.crypto import Encrypt, WordList
from tallyhold.operators import inventory, projection
from tallyhold.plans.engine import Engine
from tallyhold.sources.config import Config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyhold")
    top.add_argument("--config", default="tallyhold.toml")
    top.add_argument("--phrase-file", help="file with the recovery phrase, for an encrypted store")
    top.add_argument("--passphrase-file", help="file with a passphrase, for a store encrypted with one and the salt of encryption.salt_path")
    top.add_argument("--word-list", help="file with the 2048 words of recovery phrases")
    sub = top.add_subparsers(dest="command", required=True)
    key = sub.add_parser("key").add_subparsers(dest="key_command", required=True)
    key.add_parser("init")
    key.add_parser("verify")
    scan = sub.add_parser("scan")
    scan.add_argument("--metadata-only", action="store_true")
    for name in ("status", "dupes", "orphans", "check"):
        sub.add_parser(name)
    sub.add_parser("locate").add_argument("target")
    restore = sub.add_parser("restore")
    restore.add_argument("target")
    restore.add_argument("--out", required=True)
    gc = sub.add_parser("gc")
    gc.add_argument("--retain-after-secs", type=int)
    gc.add_argument("--confirm", action="store_true")
    return top


def _target(engine: Engine, target: str) -> str:
    paths = projection.path_to_content(engine.projection().locations, by_machine=False)
    found = inventory.resolve(paths, engine.spark.createDataFrame([(target,)], "target string")).first()
    if found.content is None:
        raise NotFoundError(target)
    return found.content


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args, spark)
    except (InventoryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    if args.command == "key":
        words = WordList.load(args.word_list or "")
        if args.key_command == "init":
            print(words.generate())
        else:
            with open(args.phrase_file, encoding="utf-8") as f:
                words.validate(f.read())
            print("the phrase is valid")
        return 0
    config = Config.load(args.config)
    transform = None
    if config.encryption:
        if not (args.passphrase_file or args.phrase_file):
            raise ConfigError("an encrypted store needs --phrase-file or --passphrase-file")
        with open(args.passphrase_file or args.phrase_file, encoding="utf-8") as f:
            held = f.read()
        transform = Encrypt.from_passphrase(held.strip("\n"), config.salt()) if args.passphrase_file else Encrypt.from_mnemonic(held)
    spark = spark or SparkSession.builder.appName("tallyhold").getOrCreate()
    engine = Engine(spark, config, transform=transform)
    if args.command == "scan":
        s = engine.run_pass(backup=not args.metadata_only)
        print(f"{s.files_seen} files, {s.bytes_seen} bytes; {s.observed} observed, {s.vanished} vanished, {s.unreadable} unreadable; {s.backed_up} backed up, {s.chunks_uploaded} of {s.chunks_total} chunks uploaded")
    elif args.command == "status":
        for name, value in engine.status().first().asDict().items():
            print(f"{name}: {value}")
        for r in engine.projection().passes.orderBy("machine", "root").collect():
            print(f"pass {r.machine[:12]} {r.root}: {r.files_seen} files, {r.bytes_seen} bytes")
    elif args.command in ("dupes", "orphans"):
        found = engine.projection()
        rows = projection.listed((inventory.duplicates if args.command == "dupes" else inventory.orphans)(found.counts), found.locations)
        for r in rows.orderBy("content").toLocalIterator():
            print(f"{r.content} {r['size']} " + " ".join(f"{x.machine[:12]}:{x.path}" for x in r.live_locations))
    elif args.command == "locate":
        content = _target(engine, args.target)
        for r in inventory.history(engine.projection().locations, content).orderBy("machine", "path").toLocalIterator():
            print(f"{r.state} {r.machine[:12]}:{r.path} hlc={r.last_hlc}")
    elif args.command == "restore":
        engine.restore(_target(engine, args.target), args.out)
        print(f"restored to {args.out}")
    elif args.command == "check":
        bad = 0
        for r in engine.check().collect():
            bad += r.first_error is not None
            print(f"{r.owner[:12]}: {r.verified} events verified" + (f", then {r.first_error}" if r.first_error else ""))
        return int(bad > 0)
    elif args.command == "gc":
        found = engine.candidates(args.retain_after_secs).persist()
        for r in found.toLocalIterator():
            print(f"{r.content} {r['size']} vanished {r.age_ns // 10**9} s ago")
        if args.confirm:
            engine.collect_garbage(found)
            print(f"{found.count()} manifests deleted")
        found.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
