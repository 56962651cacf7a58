"""Write the library as a zip for ``spark-submit --py-files``: ``python tools/bundle.py OUT.zip``."""

from __future__ import annotations

import sys
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def bundle(out: str) -> list[str]:
    """Names of the modules written, in path order; the file is the same for the same sources."""
    names = sorted(str(p.relative_to(ROOT)) for p in (ROOT / "tallyline").rglob("*.py"))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            z.writestr(zipfile.ZipInfo(name), (ROOT / name).read_bytes(), zipfile.ZIP_DEFLATED)
    return names


if __name__ == "__main__":
    print(f"{len(bundle(sys.argv[1]))} modules in {sys.argv[1]}")
