"""Output locations."""

from __future__ import annotations

from datetime import datetime


def run_path(path: str, run_id: str | None = None) -> str:
    """``path`` itself, ``path_<run_id>``, or with ``run_id='now'`` a MMddHHmmss stamp."""
    if run_id is None:
        return path
    stamp = datetime.now().strftime("%m%d%H%M%S") if run_id == "now" else run_id
    return f"{path.rstrip('/')}_{stamp}"
