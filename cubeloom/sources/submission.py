"""Submission documents from a sheet of samples."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_LAYOUTS = {20: "SINGLE", 24: "PAIRED"}


def layout_of(columns: int) -> str:
    """Single or paired, by the number of a sheet's columns."""
    if columns not in _LAYOUTS:
        raise ValueError(f"a submission sheet has 20 or 24 columns, not {columns}")
    return _LAYOUTS[columns]


def documents(sheet: DataFrame, submission: str) -> dict[str, str]:
    """The ``submission``, ``experiment`` and ``run`` documents; a sheet has a row per sample and is read by the driver.

    Columns are taken by name: ``sample``, ``title``, ``library``, ``file1``, ``md5_1`` and, if paired, ``file2``, ``md5_2``.
    """
    rows = [r.asDict() for r in sheet.orderBy("sample").collect()]
    width = max(4, len(str(len(rows))))
    paired = "file2" in sheet.columns
    experiments, runs = [], []
    for k, row in enumerate(rows, 1):
        alias = f"{submission}_Experiment_{k:0{width}d}"
        safe = {key: escape(str(value)) for key, value in row.items()}
        kind = "PAIRED" if paired else "SINGLE"
        experiments.append(f'<EXPERIMENT alias="{alias}"><TITLE>{safe["title"]}</TITLE><SAMPLE refname="{safe["sample"]}"/><LIBRARY name="{safe["library"]}" layout="{kind}"/></EXPERIMENT>')
        files = [("file1", "md5_1")] + ([("file2", "md5_2")] if paired else [])
        listed = "".join(f'<FILE filename="{safe[f]}" checksum="{safe[m]}" checksum_method="MD5"/>' for f, m in files)
        runs.append(f'<RUN alias="{submission}_Run_{k:0{width}d}"><EXPERIMENT_REF refname="{alias}"/><FILES>{listed}</FILES></RUN>')
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    return {
        "submission": f'{head}<SUBMISSION alias="{escape(submission)}" experiments="{len(rows)}"/>\n',
        "experiment": head + "<EXPERIMENT_SET>\n" + "\n".join(experiments) + "\n</EXPERIMENT_SET>\n",
        "run": head + "<RUN_SET>\n" + "\n".join(runs) + "\n</RUN_SET>\n",
    }
