"""Commands over data files: verify-data, download, scrape-profile, linkage-attack, privacy-eval, rmse-eval, run-demo."""

from __future__ import annotations

import argparse
import sys
import urllib.request
from pathlib import Path

from veilframe.plans import report
from veilframe.sources import files as fs


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def share(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("must be between 0 and 1")
    return value


def _spark():
    from veilframe.session import session

    return session()


def _ratings(args, pairs=None):
    from veilframe.sources.header_block import read_ratings

    held = fs.data_files(args.data)
    most = getattr(args, "max_rows", None)
    return read_ratings(_spark(), [str(held[f]) for f in fs.RATING_FILES if held[f].exists()], max_rows=most, exclude_pairs=pairs)


def verify_data(args) -> int:
    found = fs.verify_files(args.data, args.require_probe)
    report.print_json(found)
    return 0 if found["ok"] else 1


def download(args) -> int:
    archive = args.archive
    if args.url:
        archive = fs.download(args.url, args.destination or Path(args.data) / Path(args.url).name)
    if archive:
        fs.unpack(archive, args.data)
    found = fs.verify_files(args.data, False)
    report.print_json(found)
    return 0 if found["ok"] else 1


def _fetch(url: str) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})) as page:
        return page.read().decode("utf-8", "replace")


def scrape_profile(args) -> int:
    from veilframe.schema import PROFILE

    rows = fs.scrape_ratings(args.ratings_url or args.user, args.user, _fetch, args.sleep_seconds)
    report.write_csv(_spark().createDataFrame(rows, PROFILE), str(args.output or f"{args.out}/imdb_{args.user}.csv"))
    return 0


def linkage_attack(args) -> int:
    from veilframe.operators.linkage import LinkageConfig, MatchConfig
    from veilframe.operators.linkage import linkage_attack as attack
    from veilframe.sources.tables import read_profile, read_titles

    spark = _spark()
    profile, titles = read_profile(spark, args.profile), read_titles(spark, str(fs.data_files(args.data)["titles"]))
    link = LinkageConfig(args.sigma, args.missing_penalty, args.min_matches, args.top_n)
    match = MatchConfig(args.fuzzy_threshold, args.fuzzy_margin, fuzzy=not args.no_fuzzy)
    matched, facts, found = attack(profile, titles, _ratings(args), args.user, match, link)
    prefix = f"linkage_{args.user}" if args.user else "linkage_all_users"
    report.write_all(args.out, **{f"{prefix}_matched_titles": matched, f"{prefix}_facts": facts, f"{prefix}_candidates": found})
    found.show(min(10, args.top_n), truncate=False)
    return 0


def privacy_eval(args) -> int:
    from veilframe.operators.attack import evaluate_releases
    from veilframe.operators.releases import make_releases

    got = make_releases(_ratings(args).cache(), args.seed, args.rare_min, args.k)
    k, trials, summary = evaluate_releases(got, tuple(args.n_known), args.trials, args.seed)
    report.write_all(args.out, privacy_k_anonymity_summary=k, privacy_linkage_trials=trials, privacy_linkage_summary=summary)
    summary.show(15, truncate=False)
    return 0


def rmse_eval(args) -> int:
    from veilframe.operators.bias import compare_releases, official_holdout, split
    from veilframe.sources.header_block import read_pairs

    if args.holdout == "probe":
        args.max_rows = args.max_scan_rows
        pairs = read_pairs(_spark(), str(fs.data_files(args.data)["pairs"]))
        train, test = official_holdout(_ratings(args).cache(), pairs, args.max_train_rows, args.max_probe_rows)
    else:
        train, test = split(_ratings(args).cache(), args.test_share, args.seed)
    got = compare_releases(train, test, epochs=args.epochs, reg=args.reg, seed=args.seed, rare_min=args.rare_min, k=args.k)
    report.write_all(args.out, utility_rmse_summary=got)
    got.show(truncate=False)
    return 0


def run_demo(args) -> int:
    """All evaluations on samples; the linkage only where there is a profile."""
    steps = [privacy_eval, rmse_eval, *([linkage_attack] if Path(args.profile).exists() else [])]
    return max(step(args) for step in steps)


#: Fixed value: the person whose profile comes with the public data set.
PERSON = "planktonrules"


def build_parser() -> argparse.ArgumentParser:
    def folders(p, **given):
        p.add_argument("--data-dir", "--data", dest="data", **(given or {"default": "data"}))
        p.add_argument("--output-dir", "--out", dest="out", **(given or {"default": "reports"}))

    top = argparse.ArgumentParser(prog="veilframe", description=__doc__)
    folders(top)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, rows: int | None = None, other: str | None = None) -> argparse.ArgumentParser:
        p = sub.add_parser(name, aliases=[other] if other else [])
        p.set_defaults(run=run)
        folders(p, default=argparse.SUPPRESS)  # before or after the command
        if rows:
            p.add_argument("--max-rows", type=positive, default=rows)
            p.add_argument("--seed", type=int, default=333)
        return p

    def releases(p, rare: int = 500):
        p.add_argument("--rare-movie-min-users", "--rare-min", dest="rare_min", type=positive, default=rare)
        p.add_argument("--k-suppression", "--k", dest="k", type=positive, default=5)

    def model(p, epochs: int = 8):
        p.add_argument("--epochs", type=positive, default=epochs)
        p.add_argument("--regularization", "--reg", dest="reg", type=float, default=10.0)

    def profile(p, user: str | None = None):
        p.add_argument("--imdb-csv", "--profile", dest="profile", default=f"data/imdb_{PERSON}.csv")
        p.add_argument("--user", default=user)

    command("verify-data", verify_data).add_argument("--require-probe", action="store_true")
    p = command("download", download, other="download-netflix")
    p.add_argument("--url")
    p.add_argument("--archive", type=Path)
    p.add_argument("--destination", type=Path)
    p = command("scrape-profile", scrape_profile, other="scrape-imdb")
    p.add_argument("--user", required=True)
    p.add_argument("--ratings-url")
    p.add_argument("--sleep-seconds", type=float, default=1.0)
    p.add_argument("--output", type=Path)
    p = command("linkage-attack", linkage_attack)
    profile(p)
    p.add_argument("--no-fuzzy", action="store_true")
    p.add_argument("--fuzzy-threshold", type=float, default=0.93)
    p.add_argument("--fuzzy-margin", type=float, default=0.03)
    p.add_argument("--rating-sigma", "--sigma", dest="sigma", type=float, default=0.75)
    p.add_argument("--missing-log-penalty", "--missing-penalty", dest="missing_penalty", type=float, default=-0.75)
    p.add_argument("--min-matches", type=positive, default=2)
    p.add_argument("--top-n", type=positive, default=50)
    p = command("privacy-eval", privacy_eval, 1_000_000)
    p.add_argument("--n-known", type=positive, nargs="+", default=[1, 2, 3])
    p.add_argument("--trials", type=positive, default=300)
    releases(p)
    p = command("rmse-eval", rmse_eval, 1_000_000)
    p.add_argument("--holdout", choices=["random", "probe"], default="random")
    p.add_argument("--max-train-rows", type=positive)
    p.add_argument("--max-probe-rows", type=positive)
    p.add_argument("--max-scan-rows", type=positive)
    p.add_argument("--test-fraction", "--test-share", dest="test_share", type=share, default=0.2)
    model(p)
    releases(p)
    p = command("run-demo", run_demo, 200_000)
    p.add_argument("--trials", type=positive, default=50)
    model(p, 6)
    releases(p, 100)
    profile(p, PERSON)
    p.set_defaults(n_known=[1, 2, 3], holdout="random", test_share=0.2, no_fuzzy=False, fuzzy_threshold=0.93, fuzzy_margin=0.03)
    p.set_defaults(sigma=0.75, missing_penalty=-0.75, min_matches=2, top_n=25)
    return top


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        return args.run(args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
