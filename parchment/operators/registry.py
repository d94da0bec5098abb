"""A registry of trained models: versions in folders of their own, one manifest that names the one in use."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from . import models

MANIFEST = "manifest.json"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


def publish(root: str, pair: tuple[PipelineModel, PipelineModel], metrics: dict) -> str:
    """The name of a new version. Its files are whole before the manifest names it, which is replaced by one move."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    models.save(f"{root}/versions/{version}", *pair)
    store, path = _store(root)
    part = f"{path}/{MANIFEST}.{version}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps({"version": version, "metrics": metrics}).encode())
    store.move(part, f"{path}/{MANIFEST}")
    return version


def manifest(root: str) -> dict | None:
    """What the manifest says; None where there is none that can be read."""
    store, path = _store(root)
    try:
        with store.open_input_stream(f"{path}/{MANIFEST}") as f:
            return json.loads(f.read())
    except (OSError, ValueError):
        return None


def obtained(spark: SparkSession, root: str, training: DataFrame | None = None, **how) -> tuple[tuple[PipelineModel, PipelineModel] | None, str]:
    """(the models or None, how they were come by): the published ones, else new ones from training, which are published, else the rules alone."""
    named = manifest(root)
    if named:
        pair = models.load(spark, f"{root}/versions/{named.get('version')}")
        if pair:
            return pair, f"loaded {named['version']}"
    if training is not None and training.limit(1).count():
        *pair, metrics = models.train(training, **how)
        return tuple(pair), f"trained {publish(root, tuple(pair), metrics)}"
    return None, "rules"
