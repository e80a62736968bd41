"""Command line: scan, diff, hash, rules. Exit codes: 0 nothing that counts, 1 warnings (or a difference), 2 failures, 3 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeproof.operators import bundle
from lakeproof.plans import audit, gate
from lakeproof.sources import web

SIDECARS = ["generation_config.json", "config.json", "tokenizer.json", "special_tokens_map.json", "added_tokens.json", "tokenizer_config.json", "processor_config.json", "chat_template.jinja", "README.md"]


def _session() -> SparkSession:
    return SparkSession.builder.appName("lakeproof").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def sidecars(spark: SparkSession, model_path: str):
    """(model_id, file_name, text) of the files beside a local model."""
    folder = os.path.dirname(os.path.abspath(model_path))
    here = [os.path.join(folder, n) for n in SIDECARS if os.path.exists(os.path.join(folder, n))]
    if not here:
        return spark.createDataFrame([], "model_id string, file_name string, text string")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(here, wholetext=True).select(F.lit(model_path).alias("model_id"), name.alias("file_name"), F.col("value").alias("text"))


def remote_target(target: str, name: str | None) -> str:
    """Where a target's model file is: itself if it is a URL or a file of a store, else a file of a repository on the hub."""
    where, at = target.removeprefix("hf://"), target.startswith("hf://")
    if "://" in target and not at:
        return target if name is None or target.endswith(".gguf") else f"{target.rstrip('/')}/{name}"
    parts = where.split("/")
    repo, inside = "/".join(parts[:2]), name or "/".join(parts[2:])
    if not inside:
        listed = json.loads(web.text(f"https://{web.TOKEN_HOST}/api/models/{repo}", 16 << 20) or "{}")
        names = [s["rfilename"] for s in listed.get("siblings", []) if isinstance(s, dict) and isinstance(s.get("rfilename"), str)]
        picked = _session().createDataFrame([(names,)], "names array<string>").select(gate.pick_file(F.col("names"))).first()[0]
        if not picked:
            raise ValueError(f"no model file in {repo}; name one with --file")
        inside = picked
    return f"https://{web.TOKEN_HOST}/{repo}/resolve/main/{inside}"


def remote_sidecars(spark: SparkSession, target: str):
    """(model_id, file_name, text) of the files beside a model at a URL, each capped by its own limit."""
    folder = target.rsplit("/", 1)[0]
    if not target.startswith(("http://", "https://")):
        raise ValueError("--bundle of a remote model needs a URL or a repository")
    got = [(target, n, web.text(f"{folder}/{n}", bundle.MOST_BYTES.get(n, bundle.MOST_OTHER))) for n in SIDECARS]
    return spark.createDataFrame([r for r in got if r[2] is not None], "model_id string, file_name string, text string")


def scan_model(spark: SparkSession, given: str, remote: bool = False, name: str | None = None, manifest: str | None = None, deep: bool = False, with_bundle: bool = False) -> dict:
    """One model's audit: file, sha256, template_sha256, findings in their final order, and notes on what was looked at and what wasn't."""
    notes, target = [], given
    if remote:
        target = remote_target(given, name)
        notes.append("only the header was read from afar; STR rules and checks of the whole file were skipped")
        if manifest:
            notes.append("--manifest needs the whole file and was ignored")
            manifest = None
    notes.append("the deep tokenizer pass ran" if deep else "the deep tokenizer pass did not run; --deep-tokenizer turns it on")
    beside = None
    if with_bundle:
        beside = remote_sidecars(spark, target) if remote else sidecars(spark, given)
        notes.append("the files beside the model were audited")
    manifests = spark.read.text(manifest, wholetext=True).select(F.lit(target).alias("model_id"), F.col("value").alias("manifest")) if manifest else None
    models, meta, tensors = audit.gguf.load_once(spark, target, sha256=str(not remote).lower(), **({"materialize": audit.DEEP_KEYS} if deep or with_bundle else {}))
    model = models.first()
    if model["parse_error"]:
        raise ValueError(model["parse_error"])
    found = audit.ordered(audit.model_findings(models, meta, tensors, deep, manifests, beside)).collect()
    template = audit.integrity.templates_of(meta).first()
    return {"file": target, "sha256": model["sha256"], "template_sha256": template["template_sha256"] if template else None, "findings": found, "notes": notes}


def scan(args) -> int:
    told = scan_model(_session(), args.file, args.remote, args.model_file, args.manifest, args.deep_tokenizer, args.bundle)
    for note in told["notes"]:
        print(f"note: {note}", file=sys.stderr)
    render = audit.render_json if args.json else audit.render_text
    print(render(told["file"], told["sha256"], told["template_sha256"], told["findings"]))
    kinds = {f["severity"] for f in told["findings"]}
    return 2 if "FAIL" in kinds else 1 if args.fail_on == "warn" and "WARN" in kinds else 0


def compared(spark: SparkSession, a: str, b: str) -> dict:
    """The differences of two models: metadata, tensors, template_changed, template_diff."""
    parts = audit.diff(spark, a, b)
    out = {part: [r.asDict() for r in parts[part].orderBy("key").collect()] for part in ("metadata", "tensors")}
    template = parts["template"].first()
    return out | {"template_changed": template["changed"], "template_diff": template["diff"] if template["changed"] else []}


def diff(args) -> int:
    out = compared(_session(), args.a, args.b)
    if args.json:
        print(json.dumps(out, indent=2))
    else:
        for part in ("metadata", "tensors"):
            for r in out[part]:
                print(f"{part} {r['change']}: {r['key']}")
        print("\n".join(out["template_diff"]) if out["template_changed"] else "template: same")
    return int(bool(out["metadata"] or out["tensors"] or out["template_changed"]))


def hash_(args) -> int:
    row = audit.hashes(_session(), args.file).first()
    if args.manifest:
        with open(args.manifest, "w", encoding="utf-8") as f:
            f.write(row["manifest"])
    shown = {"file": args.file, "sha256": row["sha256"], "template_sha256": row["template_sha256"]}
    print(json.dumps(shown, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in shown.items()))
    return 0


def rules(args) -> int:
    listed = audit.rule_list()
    print(json.dumps(listed, indent=2) if args.json else "\n".join(f"{r['rule_id']} {r['severity']:4} {r['title']}" for r in listed))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeproof", description=__doc__)
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("scan")
    s.add_argument("file")
    s.add_argument("--json", action="store_true")
    s.add_argument("--manifest")
    s.add_argument("--remote", action="store_true", help="the target is a URL, a file of a store, or a repository of the hub; only its header is read")
    s.add_argument("--file", dest="model_file", metavar="NAME", help="with --remote, the model file to read")
    s.add_argument("--fail-on", choices=["warn", "fail"], default="fail")
    s.add_argument("--deep-tokenizer", action="store_true")
    s.add_argument("--bundle", action="store_true")
    s.set_defaults(run=scan)
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("--json", action="store_true")
    d.set_defaults(run=diff)
    h = sub.add_parser("hash")
    h.add_argument("file")
    h.add_argument("--json", action="store_true")
    h.add_argument("--manifest")
    h.set_defaults(run=hash_)
    r = sub.add_parser("rules")
    r.add_argument("--json", action="store_true")
    r.set_defaults(run=rules)
    return p


#: Choices of the menu: what it says, what it asks for, and the arguments these become.
MENU = [
    ("scan a model file here", ["model file"], lambda f: ["scan", f]),
    ("scan a model elsewhere by its header", ["URL or repository", "file name, or nothing"], lambda t, f: ["scan", t, "--remote", *(["--file", f] if f else [])]),
    ("compare two model files", ["first file", "second file"], lambda a, b: ["diff", a, b]),
    ("hash a model file", ["model file", "where to write a manifest, or nothing"], lambda f, m: ["hash", f, *(["--manifest", m] if m else [])]),
    ("list the rules", [], lambda: ["rules"]),
]


def menu(ask=input) -> int:
    """Ask what to do until there is no more answer."""
    while True:
        print("\n".join([*(f"{n}  {says}" for n, (says, *_) in enumerate(MENU, 1)), "q  quit"]))
        try:
            choice = ask("> ").strip()
            if choice == "q":
                return 0
            if not choice.isdigit() or not 1 <= int(choice) <= len(MENU):
                continue
            _, wanted, arguments = MENU[int(choice) - 1]
            main(arguments(*[ask(f"{w}: ").strip() for w in wanted]))
        except EOFError:
            return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv and sys.stdin.isatty() and sys.stdout.isatty():
        return menu()
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
