"""A crawl's decisions card by card, with what a run remembers between batches kept as state.

A run (corrida) reads listings (listado) one after the other, each in scrolls. A card's
item counts once in a run, wherever it comes first; runs of foreign or known cards,
scrolls without anything new, a separator and a limit of links each end a listing.
What a card means depends on all cards before it, so a run is one sequence: runs are
dealt to tasks by key, and a run's cards pass in order, never gathered but for the part
of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of cards, and what is added to them.
CARDS = ("corrida", "listado", "scroll", "lugar", "item", "fuera", "existente", "separador")
DECISIONS = "corrida long, listado long, scroll long, lugar long, item string, decision string, motivo string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    """Cards in a row that end a listing (0: never), scrolls in a row without anything new, links of a run (0: no limit)."""

    outside: int = 10
    existing: int = 5
    stalled: int = 5
    links: int = 50


@dataclass
class Run:
    """What a run remembers, besides the items it has seen. `stopped`: why the listing (or by `limite` the run) has ended."""

    listado: int = -1
    scroll: int = -1
    stopped: str = ""
    outside: int = 0
    existing: int = 0
    stalled: int = 0
    new_here: int = 0
    outside_here: int = 0
    separator_here: bool = False
    links: int = 0
    limits: Limits = field(default_factory=Limits, repr=False, compare=False)

    def _turn_to(self, listado: int, scroll: int) -> None:
        if listado != self.listado:
            self.listado, self.scroll, self.outside, self.existing, self.stalled = listado, scroll, 0, 0, 0
            self.stopped = self.stopped if self.stopped == "limite" else ""
        elif scroll != self.scroll:
            self.stalled = 0 if self.new_here or self.outside_here else self.stalled + 1
            if not self.stopped:
                self.stopped = "separador" if self.separator_here else "estancado" if self.stalled >= self.limits.stalled else ""
            self.scroll = scroll
        else:
            return
        self.new_here, self.outside_here, self.separator_here = 0, 0, False

    def decide(self, listado: int, scroll: int, item: str, outside: bool, existing: bool, separator: bool, first: Callable[[str], bool]) -> str:
        """What becomes of a card; `first` says (and remembers) whether the run has not seen the item yet."""
        self._turn_to(listado, scroll)
        if self.stopped:
            return "detenida"
        if separator:
            self.separator_here = True
            return "separador"
        if not first(item):
            return "repetida"
        if outside:
            self.outside += 1
            self.outside_here += 1
            if 0 < self.limits.outside <= self.outside:
                self.stopped = "inventario"
            return "fuera"
        self.outside = 0
        if existing:
            self.existing += 1
            if 0 < self.limits.existing <= self.existing:
                self.stopped = "guardado"
            return "existente"
        self.existing = 0
        self.new_here += 1
        self.links += 1
        if 0 < self.limits.links <= self.links:
            self.stopped = "limite"
        return "nueva"


def _ordered(cards: pd.DataFrame) -> pd.DataFrame:
    return cards.sort_values(["listado", "scroll", "lugar"], kind="stable")


def _decided(run: Run, cards: pd.DataFrame, first: Callable[[str], bool]) -> pd.DataFrame:
    out = []
    for c in cards.itertuples(index=False):
        decision = run.decide(c.listado, c.scroll, c.item, bool(c.fuera), bool(c.existente), bool(c.separador), first)
        out.append((decision, run.stopped))
    return cards[["corrida", "listado", "scroll", "lugar", "item"]].assign(decision=[d for d, _ in out], motivo=[m for _, m in out])


def crawl_decisions(cards: DataFrame, limits: Limits | None = None) -> DataFrame:
    """corrida, listado, scroll, lugar, item, decision, motivo (why the listing has ended by then; else blank) of a table of cards.

    decision: nueva, repetida, fuera, existente, separador, or detenida once the
    listing has ended. Cards are taken by listado, scroll and lugar, in batches; a
    worker holds the items of one run. Nulls of flags count as false.
    """
    limits = limits or Limits()

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, seen, corrida = Run(limits=limits), set(), None

        def first(item: str) -> bool:
            new = item not in seen
            seen.add(item)
            return new

        for batch in batches:
            for key, part in batch.groupby("corrida", sort=True):
                if key != corrida:
                    run, corrida = Run(limits=limits), key
                    seen.clear()
                yield _decided(run, part, first)

    rows = _filled(cards).repartition("corrida").sortWithinPartitions("corrida", "listado", "scroll", "lugar")
    return rows.mapInPandas(decide, DECISIONS)


def _filled(cards: DataFrame) -> DataFrame:
    return cards.select(*CARDS).where("corrida IS NOT NULL").fillna(False, ["fuera", "existente", "separador"])


class _Crawl(StatefulProcessor):
    """The same decisions with a run's counters and items in the state store."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "listado long, scroll long, stopped string, outside long, existing long, stalled long, new_here long, outside_here long, separator_here boolean, links long"
        self.run = handle.getValueState("run", fields)
        self.seen = handle.getMapState("seen", "item string", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kept = self.run.get() if self.run.exists() else ()
        run = Run(*kept, limits=self.limits)

        def first(item: str) -> bool:
            if self.seen.containsKey((item,)):
                return False
            self.seen.updateValue((item,), (True,))
            return True

        cards = _ordered(pd.concat(list(rows)))  # of one run in one batch
        yield _decided(run, cards, first)
        self.run.update(tuple(v for k, v in asdict(run).items() if k != "limits"))

    def close(self) -> None:
        pass


def crawl_stream(cards: DataFrame, limits: Limits | None = None) -> DataFrame:
    """`crawl_decisions` of a stream: batches may split the cards anywhere, as long as a run's cards come in their order.

    State is kept in RocksDB, which the session is set to; with a checkpoint a query
    that starts again goes on where it was.
    """
    cards.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return _filled(cards).groupBy("corrida").transformWithStateInPandas(statefulProcessor=_Crawl(limits or Limits()), outputStructType=DECISIONS, outputMode="Append", timeMode="None")
