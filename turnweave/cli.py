"""``python -m turnweave.cli meeting.m4a``: a transcript of one recording, as ``OUTPUT_DIR/STEM.txt``.

Without ``--json-dir`` the speech tools are run; with it, their documents ``STEM.json`` are read from there, and those
of the diarization from ``--turns-dir``.
"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnweave.functions.scalars import stem
from turnweave.plans import batch
from turnweave.sources.backends import Backend, JsonFolder, speaker_tool, speech_tool
from turnweave.sources.documents import told_plainly
from turnweave.sources.sinks import write_single

log = logging.getLogger("turnweave")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnweave", description="Transcribe a recording, with speakers if wanted.")
    p.add_argument("audio", help="path of the audio file")
    p.add_argument("--diarize", action="store_true", help="label lines with speakers")
    p.add_argument("--hf-token", help="access token of the speaker models")
    p.add_argument("-o", "--output-dir", default=".", help="folder of the transcript")
    p.add_argument("--json-dir", help="folder with the transcription's document")
    p.add_argument("--results-dir", help="folder that keeps the tools' documents, so that a later run need not call them again")
    p.add_argument("--turns-dir", help="folder with the diarization's document")
    p.add_argument("--strict", action="store_true", help="take the documents' fields as they are: a null speaker is printed, text must be text")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = parser()
    args = p.parse_args(argv)
    if args.diarize and not args.hf_token and not args.turns_dir:
        p.error("--diarize needs --hf-token")
    os.makedirs(args.output_dir, exist_ok=True)
    spark = spark or SparkSession.builder.appName("turnweave").getOrCreate()
    name = os.path.basename(args.audio)
    one = spark.createDataFrame([(name, args.audio)], "name string, path string").select(stem(F.col("name")).alias("rec"), "path")
    rec = one.first()["rec"]
    log.info("transcribing %s", name)
    speech: Backend = JsonFolder(args.json_dir) if args.json_dir else speech_tool(args.results_dir)
    speakers: Backend | None = None
    if args.diarize:
        log.info("finding the speakers of %s", name)
        speakers = JsonFolder(args.turns_dir) if args.turns_dir else speaker_tool(args.hf_token, args.results_dir)
    lines = batch.lines(spark, one, speech, speakers, args.strict)
    path = os.path.join(args.output_dir, f"{rec}.txt")
    with told_plainly():
        write_single(lines, path)
    log.info("wrote %s", path)
    return path


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    main()
