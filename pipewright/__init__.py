"""pipewright: a piped analytics language and training-data operators on Spark DataFrames."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from pathlib import Path

_HERE = Path(__file__).resolve().parent


def archive() -> bytes:
    """This package's modules as a ZIP file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(_HERE.parent))), p.read_bytes())
    return out.getvalue()


def add_archive(spark) -> None:
    """Puts the package into the cluster's shared folder and has every Python worker load it from there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base or getattr(spark.sparkContext, "_pipewright", False):
        return
    from pyarrow import fs

    data = archive()
    system, path = fs.FileSystem.from_uri(base)
    name = f"pipewright-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(data)
    spark.sparkContext.addPyFile(f"{base.rstrip('/')}/{name}")
    spark.sparkContext._pipewright = True


def ship(spark) -> None:
    """Lets Python workers import this package: from where the driver has it if they run on its machine, else from the
    shared folder (where that is unset, the package must be installed on the executors)."""
    if not spark.sparkContext.master.startswith("local"):
        add_archive(spark)
        return
    root = str(_HERE.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def __getattr__(name: str):
    if name in ("Engine", "Pipe"):
        from pipewright import engine

        return getattr(engine, name)
    raise AttributeError(name)
