"""What a service brings along: its sources, what is extracted of its pages, and the rows that its site shows. Each step is a DataFrame in and a DataFrame out."""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from tideglass.operators.extract import Spec


class Service(ABC):
    """Subclasses say what is theirs; the rest has a default that does nothing."""

    #: Kinds of operators whose pages may be crawled (NULL for the default), and whether the declared pages are all there is.
    crawlable_kinds: list[str] | None = None
    declared_pages_only = False

    @abstractmethod
    def sources(self, spark: SparkSession) -> DataFrame:
        """Rows as ``config.sources`` gives them."""

    @abstractmethod
    def spec(self, kind: str) -> Spec | None:
        """What is taken from pages of a kind; None for nothing."""

    @abstractmethod
    def records(self, items: DataFrame) -> DataFrame:
        """record_id and content of the items that were extracted, for the record store."""

    def finalize(self, records: DataFrame) -> DataFrame:
        return records

    @abstractmethod
    def pages(self, records: DataFrame) -> DataFrame:
        """path, url_path, locale, alternates, noindex and html of the pages to build."""

    def search_index(self, records: DataFrame) -> DataFrame | None:
        return None

    def redirects(self, records: DataFrame) -> DataFrame | None:
        return None

    def assets(self, spark: SparkSession) -> DataFrame | None:
        return None

    def publish_metrics(self, records: DataFrame) -> DataFrame | None:
        """metric, count, total, which a guard compares with those published last."""
        return None

    def recheck_targets(self, records: DataFrame) -> DataFrame | None:
        """key, label, checked, failures of what is confirmed again from time to time."""
        return None


def load_service(name: str) -> Service:
    """The service that a module has under ``service``, or builds with ``Service``."""
    module = importlib.import_module(name)
    found = getattr(module, "service", None)
    found = found() if isinstance(found, type) else found
    if not isinstance(found, Service):
        raise TypeError(f"{name} has no service")
    return found
