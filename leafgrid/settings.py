"""What a conversion can be told, and which of it makes an earlier recognition stale."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass
class Settings:
    lang: str = "vie"
    font: str = "Times New Roman"
    paper: str = "A4"
    auto_crop: bool = True
    detect_tables: bool = True
    keep_figures: bool = True
    fix_diacritics: bool = True
    background: str = "auto"

    def ocr_key(self) -> str:
        """The settings that recognition depends on, as one value of a table's column."""
        return json.dumps([self.lang, self.auto_crop, self.detect_tables, self.keep_figures, self.fix_diacritics])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Unknown names are ignored, values take the type of their default."""
        given, out = json.loads(text), cls()
        for f in fields(cls):
            if f.name in given:
                default, value = getattr(out, f.name), given[f.name]
                setattr(out, f.name, str(value).lower() in ("true", "1") if isinstance(default, bool) else type(default)(value))
        return out


def page_workers(cpus: int) -> int:
    """Pages that one machine works on at a time: half its cores, one at least and four at most.

    On a cluster this is what ``spark.task.cpus`` is set from: cores over workers.
    """
    return max(1, min(4, cpus // 2))
