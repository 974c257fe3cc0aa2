"""Id selectors: sets, lists, their negations, and selectors over external ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selector:
    """Narrows a DataFrame to the rows whose id it selects. `size` is None if it can't be enumerated."""

    size: int | None = None

    def apply(self, rows: DataFrame, column: str = "doc_id", negate: bool = False) -> DataFrame:
        raise NotImplementedError

    def ids(self) -> list[int]:
        raise TypeError("this selector can't be enumerated")

    def ordered_ids(self) -> list[int]:
        return sorted(self.ids())


#: Up to so many ids are a literal list in the plan; more are a joined table.
LITERAL_IDS = 1000


class ListSelector(Selector):
    """Ids in a list; repeats count for `size`, not for results."""

    def __init__(self, ids):
        self._ids = [int(x) for x in ids]
        self.size = len(self._ids)

    def ids(self) -> list[int]:
        return list(self._ids)

    def apply(self, rows, column="doc_id", negate=False):
        some = sorted(set(self._ids))
        if len(some) <= LITERAL_IDS:
            inside = F.col(column).isin(some) if some else F.lit(False)
            return rows.where(~inside if negate else inside)
        table = rows.sparkSession.createDataFrame([(x,) for x in some], f"{column} bigint")
        return rows.join(table, column, "left_anti" if negate else "left_semi")


class SetSelector(ListSelector):
    """Ids in a set."""

    def __init__(self, ids):
        super().__init__(dict.fromkeys(int(x) for x in ids))


class FrameSelector(Selector):
    """Ids in a column `id` of a DataFrame of any size; counted: its rows are counted, so that a small one is told."""

    def __init__(self, ids: DataFrame, counted: bool = False):
        self.frame = ids
        self.size = ids.count() if counted else None

    def apply(self, rows, column="doc_id", negate=False):
        return rows.join(self.frame.select(F.col("id").alias(column)), column, "left_anti" if negate else "left_semi")


class WhereSelector(Selector):
    """Ids for which a boolean expression of the id holds."""

    def __init__(self, test):
        self.test = test

    def apply(self, rows, column="doc_id", negate=False):
        holds: Column = F.coalesce(self.test(F.col(column)), F.lit(False))
        return rows.where(~holds if negate else holds)


class NotSelector(Selector):
    """All ids but those of another selector."""

    def __init__(self, selector: Selector):
        self.inner = selector

    def apply(self, rows, column="doc_id", negate=False):
        return self.inner.apply(rows, column, not negate)


class MappedSelector(Selector):
    """A selector over external ids, for rows with ordinals; ids that aren't mapped select nothing but still count for `size`."""

    def __init__(self, selector: Selector, id_map: DataFrame):
        self.inner, self.id_map, self.size = selector, id_map, selector.size

    def ids(self) -> list[int]:
        """Ordinals of the ids that are mapped, for a selector that can be enumerated."""
        self.inner.ids()
        return [r[0] for r in self.inner.apply(self.id_map, "ext_id").select("doc_id").collect()]

    def apply(self, rows, column="doc_id", negate=False):
        chosen = self.inner.apply(self.id_map, "ext_id").select(F.col("doc_id").alias(column))
        return rows.join(chosen, column, "left_anti" if negate else "left_semi")


def is_small(selector: Selector | None, k: int) -> bool:
    """Whether search gives way to exact matching of the selected ids."""
    return selector is not None and selector.size is not None and selector.size <= k
