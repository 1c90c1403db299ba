"""How templates of a miner stood in the text: what parted their tokens and what their placeholders may have been."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.masking import custom_masks, domain_masks
from logweave.rules.masks import CLUSTER_TOKEN_PATTERNS, CUSTOM_DELIMITERS, MESSAGE_DELIMITERS, PLACEHOLDER_PATTERNS
from logweave.rules.timestamps import TIMESTAMP_CATALOGUE

_NAME = re.compile(r"<[A-Z0-9_*]+>")
_GROUP_NAME = re.compile(r"\(\?P<\w+>")
#: Lines of rule characters that are cut from the beginning of a message before it is mined.
_RULED_LINES = r"\s*(?:[^\S\n]*[*=\-]{5,}[^\S\n]*(?:\n|\z))*"


@dataclass(frozen=True)
class Dialect:
    """A miner's view of a message. ``bare``: brackets are delimiters, so placeholders stand in templates without them."""

    delimiters: str
    masks: tuple[tuple[str, str], ...]
    bare: bool
    known: dict[str, str] = field(hash=False)
    timestamps: Sequence[str] = ()

    @property
    def parting(self) -> str:
        """One character that parts tokens."""
        return r"[\s" + re.sub(r"([\\\[\]^\-&])", r"\\\1", self.delimiters) + "]"

    @cached_property
    def placeholders(self) -> dict[str, str]:
        """What a placeholder may stand for, by its spelling in templates; also the spelling itself.

        A mask may change what an earlier one has written (``<BASE64_BLOB>`` holds digits), so the spellings are what the
        later masks leave of a placeholder.
        """
        means: dict[str, list[str]] = {"<*>": [r".*?"]}
        for at, (_, written) in enumerate(self.masks):
            for name in _NAME.findall(written):
                body = self.known[name]
                if name == "<TIMESTAMP>":
                    # Stamps stand at the beginning of a line, which a rule knows from what surrounds them.
                    body = "|".join(f"(?:{p.removeprefix('^')})" for p in [body, *self.timestamps])
                left = name
                for pattern, replacement in self.masks[at + 1 :]:
                    left = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", replacement), left)
                spelled = left.strip("<>") if self.bare else left
                found = means.setdefault(spelled, [re.escape(spelled), *([re.escape(left)] if self.bare else [])])
                if body not in found:
                    found.append(body)
        return {
            name: "(?:" + _GROUP_NAME.sub("(?:", "|".join(bodies[::-1])).replace(r"\Z", r"\z") + ")" for name, bodies in means.items()
        }

    def fragment(self, token: Column) -> Column:
        """Pattern of one token of a template."""
        from logweave.operators.patterns import escape_literal

        if self.bare:
            table = F.create_map(*[F.lit(item) for pair in self.placeholders.items() for item in pair])
            return F.coalesce(F.element_at(table, token), escape_literal(token))
        pattern = escape_literal(token)
        for name in sorted(self.placeholders, key=len, reverse=True):
            pattern = F.replace(pattern, F.lit(name.replace("*", r"\*")), F.lit(self.placeholders[name]))
        return pattern

    def masked(self, token: Column) -> Column:
        """Whether nothing need part a token from its neighbours: brackets of a placeholder were taken for delimiters."""
        return token.isin(list(self.placeholders)) if self.bare else F.lit(False)

    def gap(self, optional: Column) -> Column:
        return F.when(optional, self.parting + "*").otherwise(self.parting + "+")

    def whole(self, body: Column) -> Column:
        """A rule for whole messages from a body of tokens; word and digit classes hold for all scripts, as in the masks."""
        return F.concat(F.lit(rf"(?sU)^{_RULED_LINES}{self.parting}*(?:"), body, F.lit(f"){self.parting}*$"))

    def body(self, tokens: Column) -> Column:
        """The tokens of one template in order."""
        return self.joined(F.transform(tokens, lambda t: F.struct(self.fragment(t).alias("slot"), self.masked(t).alias("masked"))))

    def joined(self, parts: Column) -> Column:
        """Slots ``(slot, masked)`` in order, with gaps between."""
        def piece(part: Column, at: Column) -> Column:
            before = F.get(parts, at - 1)
            return F.concat(F.when(at == 0, "").otherwise(self.gap(part["masked"] | before["masked"])), part["slot"])

        return F.array_join(F.transform(parts, piece), "")


def first_match_dialect(timestamps: Sequence[str] = ()) -> Dialect:
    """Templates of the first-match miner."""
    stamps = tuple(timestamps) or tuple(TIMESTAMP_CATALOGUE)
    known = {**CLUSTER_TOKEN_PATTERNS, **PLACEHOLDER_PATTERNS}
    return Dialect(CUSTOM_DELIMITERS, tuple(custom_masks(stamps)), True, known, stamps)


def best_match_dialect(raw: bool = False, timestamps: Sequence[str] = ()) -> Dialect:
    """Templates of the best-match miner; raw lines are parted by white space only and have their timestamps masked."""
    stamps = tuple(timestamps) or tuple(TIMESTAMP_CATALOGUE)
    masks = domain_masks(raw, stamps)
    return Dialect("" if raw else MESSAGE_DELIMITERS, tuple(masks), False, PLACEHOLDER_PATTERNS, stamps if raw else ())
