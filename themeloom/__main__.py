"""`spark-submit --py-files themeloom.zip themeloom/__main__.py INPUT OUTPUT` or `python -m themeloom INPUT OUTPUT`."""

from __future__ import annotations

import argparse

from themeloom import settings as S
from themeloom.operators.records import parse_column_specs
from themeloom.plans import job
from themeloom.runtime import build_session, clear


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("themeloom", description="Cluster the texts of CSV files.")
    parser.add_argument("input", help="a CSV file, or a folder or pattern of several")
    parser.add_argument("output", help="folder that gets a new folder for this run")
    parser.add_argument("--text-col", help="the text column; without one the best-ranked column is taken")
    parser.add_argument("--text-cols", help="several columns that make up the text, as a,b")
    parser.add_argument("--column-labels", help="names that several columns go by, as a=Label,b=Label")
    parser.add_argument("--target", choices=sorted(S.TARGETS), default=S.DEFAULT_TARGET)
    parser.add_argument("--methods", default=",".join(S.METHODS), help="methods to try, as a,b")
    parser.add_argument("--max-length", type=int, default=S.MAX_TEXT_LENGTH, help="characters kept of a text; 0 keeps all")
    parser.add_argument("--sample-size", type=int, help="rows that take part in the sweep; without it all do")
    parser.add_argument("--every-row", action="store_true", help="write every row, not one for each text")
    parser.add_argument("--escape-formulas", action="store_true", help="guard cells that a spreadsheet would run")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> str:
    options = arguments(given)
    names, labels = parse_column_specs(options.text_col, options.text_cols, options.column_labels)
    spark = build_session()
    folder = job.classify_csv(
        spark, options.input, options.output, every_row=options.every_row, escape_formulas=options.escape_formulas,
        text_col=options.text_col, text_cols=names or None, labels=labels or None, target=options.target,
        methods=tuple(options.methods.split(",")), max_length=options.max_length or None, sample_size=options.sample_size,
    )
    clear(spark)  # this run is all that the application did
    return folder


if __name__ == "__main__":
    print(main())
