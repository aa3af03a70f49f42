"""Fill containers of fixed capacity with documents, sized in tokens of a public tokenizer.

Method. Bounded-space online best fit: at most ``OPEN`` containers are open at a time. A bitset, keyed by free space, has a
bit for every free space an open container has; the best fit for an item is the lowest bit not below its size, found with
two integer operations. If nothing fits, a new container is opened; if all places are taken, the fullest open container
closes first. Only documents above the capacity are divided, into full containers and a rest that is packed like any item.

Every partition of the scan packs its own stream, without a shuffle; what is still open at its end is joined once more,
whole container into whole container, by the same rule. So at most ``OPEN`` containers per partition are not as full as the
rule makes them, whatever the size of the data. Container ids are made of partition and number and come out the same when
a lost partition is computed again.

Null texts and texts of no token go into no container. Repeated documents are packed as often as they occur. Sizes of items
are token counts of the whole text. The container classes are a short list (at most ``MAX_CLASSES``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: The vocabulary file, unless the session's ``spark.lumenfield.tokenizer`` names another. Only the driver must have it.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary wants text split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN = 256
MAX_CLASSES = 1000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The encoding of a vocabulary file of ranks, once a worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, name: str = "tokens", path: str | None = None) -> DataFrame:
    """Add the token count of a text column; null for null. The vocabulary file travels to the executors with the job."""
    spark = df.sparkSession
    ship(spark)
    path = path or spark.conf.get("spark.lumenfield.tokenizer", TOKENIZER)
    spark.sparkContext.addFile(path)
    file = Path(path).name

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(SparkFiles.get(file)).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if isinstance(t, str) else None for t in batch], dtype="Int32")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(count, "int").asNondeterministic()(F.col(text)))


class Packer:
    """Bounded-space best fit for one container class: ``put`` returns the container of an item."""

    def __init__(self, capacity: int, places: int = OPEN) -> None:
        self.capacity, self.places = capacity, places
        self.bits = 0  # bit f: some open container has f tokens left
        self.at: dict[int, list[int]] = {}  # free space -> open containers
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.at[free]
        container = own.pop()
        if not own:
            del self.at[free]
            self.bits ^= 1 << free
        self.open -= 1
        return container

    def _leave(self, container: int, free: int) -> None:
        if free:
            self.at.setdefault(free, []).append(container)
            self.bits |= 1 << free
            self.open += 1

    def put(self, size: int) -> int:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            container = self._take(free)
        else:
            if self.open >= self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, container = self.capacity, self.made
            self.made += 1
        self._leave(container, free - size)
        return container

    def rest(self) -> dict[int, int]:
        """What is still open, joined by best fit of decreasing size: container -> container it is emptied into."""
        last = Packer(self.capacity, 1 << 60)
        named: dict[int, int] = {}
        into: dict[int, int] = {}
        for free in sorted(self.at):
            for container in self.at[free]:
                k = last.put(self.capacity - free)
                into[container] = named.setdefault(k, container)
        return into


PACKED = "container_class string, capacity_tokens int, container_id long, doc_id long, part int, token_start int, tokens int"


def pack(sized: DataFrame, classes: list[tuple[str, int]]) -> DataFrame:
    """Containers for (doc_id, tokens), for every class: one row per document and part."""
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} container classes")
    ship(sized.sparkSession)

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        packers = [Packer(capacity) for _, capacity in classes]
        late: list[list[tuple]] = [[] for _ in classes]
        for batch in batches:
            for k, (name, capacity) in enumerate(classes):
                packer, rows = packers[k], []
                for doc_id, size in zip(batch.doc_id.tolist(), batch.tokens.tolist()):
                    for part in range(-(-size // capacity)):
                        start = part * capacity
                        own = min(capacity, size - start)
                        rows.append((packer.put(own), doc_id, part, start, own))
                rows += late[k]
                still = {c for own in packer.at.values() for c in own}
                late[k] = [r for r in rows if r[0] in still]  # an open container may still be emptied into another
                yield frame(name, capacity, [r for r in rows if r[0] not in still], base)
        for k, (name, capacity) in enumerate(classes):
            into = packers[k].rest()
            yield frame(name, capacity, [(into.get(r[0], r[0]), *r[1:]) for r in late[k]], base)

    def frame(name: str, capacity: int, rows: list[tuple], base: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["container_id", "doc_id", "part", "token_start", "tokens"])
        out["container_id"] += base
        return out.assign(container_class=name, capacity_tokens=capacity)[["container_class", "capacity_tokens", "container_id", "doc_id", "part", "token_start", "tokens"]]

    return sized.select("doc_id", "tokens").where("tokens > 0").mapInPandas(partition, PACKED)
