"""Python workers need this package too."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def ship(spark) -> None:
    """Sends the package to the workers, once a session, unless they find it where the driver runs."""
    context = spark.sparkContext
    if getattr(context, "_runweave_shipped", False):
        return
    context._runweave_shipped = True
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if any(os.path.realpath(p) == str(ROOT) for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="runweave-"), "runweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "runweave").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(path)


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a temporary one if all runs on
    this machine (as in tests), and an error on a cluster, where each machine would see its own."""
    ship(spark)
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="runweave-")
        shared_folder.own = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder
