"""Technology profiles U1-U4: which files matter and which change signals exist.

* ``base``   -- keeps every file, message rules + comment signal only;
* ``ansible``-- keeps Ansible files (path rule P1), adds data/include/service change signals;
* ``tosca``  -- keeps TOSCA files (header in content, else path rule P2), message rules + comment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.paths import is_ansible_file, is_tosca_file


@dataclass(frozen=True)
class Profile:
    name: str
    keep: Callable[[Column, Column], Column]   # U1: (path, content) -> Column[bool]; the negation of "ignore"
    ansible_signals: bool = False              # U3: data/include/service change signals
    metrics: str | None = None                 # U2: product-metric family (None: no product metrics)

    def ignore(self, path: Column, content: Column) -> Column:
        return ~self.keep(path, content)

    def change_signals(self, files: DataFrame, diff_lines: DataFrame,
                       families: DataFrame | None = None) -> DataFrame:
        """Commit-level change signals of this technology."""
        from faultline.operators.classify import change_signals
        return change_signals(files, diff_lines, ansible=self.ansible_signals,
                              families=families)

    def product_metrics(self, docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame | None:
        """Product metrics of documents (one per row), or None for a profile without any."""
        if self.metrics is None:
            return None
        from faultline.operators.product import product_metrics
        return product_metrics(docs, keys, self.metrics, content)


BASE = Profile("base", lambda path, content: F.lit(True))
ANSIBLE = Profile("ansible", lambda path, content: is_ansible_file(path), ansible_signals=True, metrics="ansible")
TOSCA = Profile("tosca", lambda path, content: is_tosca_file(path, content), metrics="tosca")

PROFILES = {p.name: p for p in (BASE, ANSIBLE, TOSCA)}


def get(name: str) -> Profile:
    return PROFILES[name]
