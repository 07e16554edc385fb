"""The driver's log as a file: a sink of the standard library's logging, with a filter by the line's beginning."""

from __future__ import annotations

import logging
import os


class Beginning(logging.Filter):
    """Lets lines through that begin with a text."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.text = text

    def filter(self, record: logging.LogRecord) -> bool:
        return record.getMessage().startswith(self.text)


def log_to(path: str, name: str = "gleaner.crawl", only: str = "worker=", console: bool = True) -> logging.Logger:
    """The logger ``name`` writing lines that begin with ``only`` to ``path`` with their time, and all lines to the console; what it
    wrote to before is closed."""
    logger = logging.getLogger(name)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    file = logging.FileHandler(path, encoding="utf-8")
    file.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%Y-%m-%d %H:%M:%S"))
    file.addFilter(Beginning(only))
    logger.addHandler(file)
    if console:
        logger.addHandler(logging.StreamHandler())
    logger.setLevel(logging.INFO)
    logger.propagate = False
    return logger
