"""Settings of an index and of searches on it."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from quillspan.functions.lexicon import STOP_WORDS


@dataclass(frozen=True)
class EngineConfig:
    """``observed`` keeps the original behaviour to the letter; with it off, entities count in all their
    documents and query keys match postings whatever their case."""

    stem: bool = False
    semantic: bool = False
    observed: bool = True
    top_k: int = 50
    pad: bool = False
    batch_size: int = 10  # corpus files per parser batch; kept with the settings, Spark splits the files itself
    corpus_path: str = ""
    index_path: str = ""
    stop_words: tuple[str, ...] = STOP_WORDS
    weights: dict[str, float] = field(
        default_factory=lambda: {"entity": 0.4, "term": 0.4, "number": 0.1, "semantic": 0.1}
    )

    @property
    def k(self) -> float:
        return 0.4 if self.stem and not self.semantic else 1.0

    @property
    def b(self) -> float:
        return 0.9 if self.stem and not self.semantic else 0.3

    @property
    def place(self) -> str:
        """Folder of the index; stemmed and unstemmed ones lie side by side."""
        return f"{self.index_path.rstrip('/')}/stemmed={str(self.stem).lower()}"

    _KEYS = {"CorpusPath": "corpus_path", "IndexPath": "index_path", "ParserBatchSize": "batch_size", "UseStemmer": "stem", "UseSemantic": "semantic"}

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        """Reads a properties file; makes one with the defaults where there is none. Unknown keys are ignored."""
        p = Path(path)
        if not p.exists():
            cls().save(path)
        got: dict[str, object] = {}
        for line in p.read_text(encoding="utf-8").splitlines():
            key, eq, value = line.partition("=")
            name = cls._KEYS.get(key.strip())
            if eq and name and not line.lstrip().startswith(("#", "!")):
                value = value.strip()
                if name == "batch_size":
                    if not re.fullmatch(r"\d{1,4}", value):
                        raise ValueError(f"ParserBatchSize must have one to four digits, not {value!r}")
                    value = int(value)
                got[name] = value.lower() == "true" if name in ("stem", "semantic") else value
        return cls(**got)

    def save(self, path: str) -> None:
        values = asdict(self)
        lines = [f"{k}={str(values[v]).lower() if isinstance(values[v], bool) else values[v]}" for k, v in self._KEYS.items()]
        Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
