"""A recognition engine as a process of its own: the page's PNG goes in, its report comes out."""

from __future__ import annotations

import os
import struct
import subprocess
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def png(img: np.ndarray) -> bytes:
    """PNG bytes of a grey or BGR image."""
    h, w = img.shape[:2]
    rows = img.reshape(h, w) if img.ndim == 2 or img.shape[2] == 1 else img[..., ::-1]
    kind = 0 if rows.ndim == 2 else 2
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, -1)], axis=1).tobytes()

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


@dataclass(frozen=True)
class ProcessEngine:
    """Runs a command for each page; a failing or late one is the page's error.

    The command reads a PNG from its input and writes its report to its output.
    It gets one thread, as tasks already share the machine.  Usable wherever an
    engine is a function of pixels, height and width.
    """

    command: Sequence[str]
    timeout: float = 600

    def __call__(self, data: bytes, height: int, width: int) -> str:
        return self.report(np.frombuffer(data, np.uint8).reshape(height, width, -1))

    def report(self, img: np.ndarray) -> str:
        done = subprocess.run(list(self.command), input=png(img), capture_output=True, timeout=self.timeout, env=os.environ | {"OMP_THREAD_LIMIT": "1"}, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace").strip()[:500] or f"exit status {done.returncode}")
        return done.stdout.decode(errors="replace")
