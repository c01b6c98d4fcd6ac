"""Log files of the driver."""

from __future__ import annotations

import logging
import time
from pathlib import Path


def file_logging(folder: str, name: str = "run", level: int = logging.INFO) -> Path:
    """Send the root logger's records to a new file of the folder, named by UTC time; returns its path."""
    path = Path(folder) / f"{name}_{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setLevel(level)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(name)s] %(message)s"))
    root = logging.getLogger()
    root.addHandler(handler)
    if root.level == logging.NOTSET or root.level > level:
        root.setLevel(level)
    return path
