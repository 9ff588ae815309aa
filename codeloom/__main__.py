"""Commands: index, import, outline, ask, serve, prompt."""

from __future__ import annotations

import argparse
import glob
import hashlib
import json
import os
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("codeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def default_store(root):
    """A folder of the user's cache for each tree, named by its path."""
    cache = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(cache, "codeloom", hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16])


def prompt_text(raw):
    """The prompt in a JSON envelope {"prompt": ...}, or none."""
    try:
        found = json.loads(raw[: 1 << 20]).get("prompt")
    except (ValueError, AttributeError):
        return ""
    return found if isinstance(found, str) else ""


def note(hits):
    """What a prompt's symbols are told as: one line each, or nothing."""
    lines = [f"  - {h['fqn']} ({h['kind']}, {h['path']}:{h['start_line']})" for h in hits]
    return "\n".join(["Indexed symbols that this prompt names:", *lines, "Ask explore, get_callers or find_references about them."]) if lines else ""


def main(argv=None):
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="bring a store up to date with a source tree")
    a.add_argument("root", nargs="?", default=".")
    a.add_argument("--store", help="a folder of the user's cache if left out")
    a.add_argument("--config", help="YAML file: include, exclude, vendor")
    a.add_argument("--force", action="store_true", help="read and parse every file anew")
    a.add_argument("--rebuild", action="store_true", help="delete the store first")
    a.add_argument("--quiet", action="store_true", help="print nothing")
    a = sub.add_parser("import", help="import enrich.*.jsonl layers of a folder")
    a.add_argument("root")
    a.add_argument("folder")
    a.add_argument("--store")
    a = sub.add_parser("outline", help="symbols of one file")
    a.add_argument("path")
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("ask", help="one question, arguments as JSON: ask get_callers '{\"fqn\": \"A::b()\"}'")
    a.add_argument("question")
    a.add_argument("arguments", nargs="?", default="{}")
    a.add_argument("--store")
    a.add_argument("--root")
    a = sub.add_parser("serve", help="answer questions given as JSON lines, at once from the store, while a run brings it up to date")
    a.add_argument("root", nargs="?", default=".")
    a.add_argument("--store")
    a.add_argument("--layers", help="folder of enrich.*.jsonl layers")
    a.add_argument("--no-index", action="store_true", help="answer from the store as it is")
    a = sub.add_parser("prompt", help='read {"prompt": ...} from the standard input and name its symbols; silent if there are none')
    a.add_argument("--root", default=".")
    a.add_argument("--store")
    args = p.parse_args(argv)
    if args.command == "outline":
        from .outline import outline_json, outline_text

        with open(args.path, encoding="utf-8", errors="replace") as f:
            print((outline_json if args.json else outline_text)(args.path, f.read()))
        return
    from .api import Graph
    from .plans import index
    from .serve import QUESTIONS, Server
    from .sources import tree
    from .sources.store import Store

    at = args.store or default_store(args.root or ".")
    if args.command == "prompt":
        try:
            text = prompt_text(sys.stdin.read())
            if text and (":/" in at or glob.glob(os.path.join(glob.escape(at), "AT-*"))):  # a prompt never makes an index
                spark = session()
                found = note(Graph(Store(spark, at if ":/" in at else "file:" + os.path.abspath(at)).tables()).hints(text))
                if found:
                    print(found)
        except Exception as e:  # a prompt must go on whatever is wrong here
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return
    spark = session()
    store = Store(spark, at if ":/" in at else "file:" + os.path.abspath(at))
    if args.command == "index":
        if args.rebuild:
            store.drop()
        settings = None
        if args.config:
            with open(args.config, encoding="utf-8") as f:
                settings = tree.config(f.read())
        found = index.run(store, args.root, settings, args.force)
        if not args.quiet:
            print(json.dumps(found))
    elif args.command == "serve":
        Server(store, args.root, layers=args.layers).serve(sys.stdin, sys.stdout, not args.no_index)
    elif args.command == "import":
        print(json.dumps(index.import_layers(store, args.root, args.folder)))
    else:
        contents = None
        if args.root:
            contents = tree.texts(args.root)
        if args.question not in QUESTIONS:
            p.error(f"questions: {', '.join(QUESTIONS)}")
        print(json.dumps(getattr(Graph(store.tables(), contents), args.question)(**json.loads(args.arguments)), ensure_ascii=False))


if __name__ == "__main__":
    main()
