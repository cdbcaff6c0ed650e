"""python -m loomgraph -d DIR [-o OUT]: folder to ranked architecture graph."""

from __future__ import annotations

import argparse
import logging
import time

from .kinds import LANGUAGES, VIEW_ALIASES
from .operators import collect as C
from .operators import rank as K
from .plans.project import load
from .plans.render import block_lines, render
from .session import local_session
from .sources.scan import write_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("-d", "--dir", action="append", default=[])
    where.add_argument("-f", "--file", action="append", default=[])
    p.add_argument("-o", "--output")
    p.add_argument("--lang", choices=[*LANGUAGES, "auto"], default="auto")
    p.add_argument("--depth", default="file", choices=[*VIEW_ALIASES, "0", "1", "2", "3"])
    p.add_argument("--top-k", type=int)
    p.add_argument("--visual", action="store_true", help="for people: shapes and colours")
    p.add_argument("--clustered", action="store_true")
    p.add_argument("--print-block", action="store_true")
    a = p.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    project = load(spark, a.dir, a.file, None if a.lang == "auto" else [a.lang])
    logging.info("graph built in %.2f s", time.time() - start)
    if a.print_block:
        for r in project.unit_meta.select("unit_id", "file_path").orderBy("unit_id").collect():
            print(f"# {r.file_path}\n{block_lines(project.graph, r.unit_id)}")
    nodes, edges = C.nodes(project.graph), C.edges(project.graph)
    if a.top_k is not None:
        scored = K.modules_of(nodes.join(K.scores(project.graph).select("block_id", "score"), "block_id"), project.unit_meta)
        nodes, edges = C.retain(nodes, edges, K.top_with_coverage(scored, a.top_k))
    nodes = C.without_orphans(nodes, edges)
    depth = int(a.depth) if a.depth.isdigit() else VIEW_ALIASES[a.depth]
    write_text(render(nodes, edges, project.unit_meta, depth, not a.visual, not a.clustered), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
