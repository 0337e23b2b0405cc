"""python -m gleanery run FILE.param | inspect INDEX_DIR COMMAND [ARG..] | te2csv OUT_DIR FILE.. | demo"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from gleanery.demo import tour
from gleanery.operators import inspection
from gleanery.plans.pipeline import Timer, run
from gleanery.sources.files import read_evaluation, read_parameters
from gleanery.sources.index import open_index
from gleanery.sources.sinks import write_evaluation_table

COMMANDS = {
    "attribute": inspection.list_attribute, "doc": inspection.list_doc, "docids": inspection.list_docids, "iid": inspection.to_iid,
    "eid": lambda ix, n: inspection.to_eid(ix, int(n)), "fields": inspection.list_fields, "metadata": lambda ix, eid, *names: inspection.list_metadata(ix, eid, list(names)),
    "postings": inspection.list_postings, "postings-sample": lambda ix, t, f: inspection.list_postings(ix, t, f, 5), "stats": inspection.list_stats,
    "terms": lambda ix, f: inspection.list_terms(ix, f).orderBy("term"), "termvector": inspection.list_termvector,
}


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "run":
        parameters = read_parameters(args[1])
        timer = Timer()
        timer.start()
        run(SparkSession.builder.getOrCreate(), parameters)
        timer.stop()
        print(timer)
        return 0
    if args == ["demo"]:
        for what, value in tour(SparkSession.builder.getOrCreate()):
            print(f"{what}: {value}")
        return 0
    if len(args) >= 3 and args[0] == "te2csv":
        values = read_evaluation(SparkSession.builder.getOrCreate(), args[2:])
        sizes = {r["count"] for r in values.groupBy("path").count().collect()}
        if len(sizes) != 1:
            print("Error: the files must be of the same length")
            return 1
        write_evaluation_table(values, [os.path.basename(f) for f in args[2:]], args[1])
        return 0
    if len(args) >= 3 and args[0] == "inspect" and args[2] in COMMANDS:
        index = open_index(SparkSession.builder.getOrCreate(), args[1])
        if args[2] == "eid":
            try:
                inspection.check_docid(index, int(args[3]))
            except ValueError as e:
                print(f"Error: {e}")
                return 1
        for row in COMMANDS[args[2]](index, *args[3:]).toLocalIterator():
            print(*row, sep="\t")
        return 0
    print(__doc__, "Commands:", ", ".join(COMMANDS))
    return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
