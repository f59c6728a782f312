"""Logging, seeds and paths."""

from __future__ import annotations

import logging
import os
import random
from pathlib import Path

import numpy as np

DEFAULT_SEED = 42
#: The folder that holds the package, and the places for data below it.
PROJECT_ROOT = Path(__file__).resolve().parents[1]
DATA_DIR = PROJECT_ROOT / "data"
RAW_DIR = DATA_DIR / "raw"
STORE_DIR = DATA_DIR / "store"
REPORTS_DIR = PROJECT_ROOT / "reports"


def get_logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """A logger that writes to stderr, with one handler however often it is asked for."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    logger.propagate = False
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    return logger


def set_seed(seed: int | None = None) -> int:
    """Seed random and numpy of this process and PYTHONHASHSEED of its children; the seed used."""
    used = DEFAULT_SEED if seed is None else seed
    os.environ["PYTHONHASHSEED"] = str(used)
    random.seed(used)
    np.random.seed(used)
    return used


def ensure_dir(path: str | os.PathLike) -> Path:
    """The folder, made with its parents where it is missing."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    return folder
