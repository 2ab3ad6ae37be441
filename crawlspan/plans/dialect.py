"""Expressions that Spark SQL and DuckDB spell differently, so that one builder serves the engine and its oracle."""

from __future__ import annotations

# Words that carry no topic in a query.
STOP_WORDS = "the a an and or of for to in on with your you is are best how what vs why can".split()
# Expected click-through rate by position.
CTR = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.032, 9: 0.028, 10: 0.025}


class Dialect:
    duck = False

    def rlike(self, s: str, pattern: str) -> str:
        return f"{'regexp_matches' if self.duck else 'regexp_like'}({s}, '{pattern}')"

    def sub(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, '{pattern}', '{to}'{', ' + repr('g') if self.duck else ''})"

    def split(self, s: str, pattern: str) -> str:
        return f"{'string_split_regex' if self.duck else 'split'}({s}, '{pattern}')"

    def strings(self, values) -> str:
        items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        return f"[{items}]" if self.duck else f"array({items})"

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}" if self.duck else f"{var} -> {body}"

    def filter(self, a: str, var: str, body: str) -> str:
        return f"{'list_filter' if self.duck else 'filter'}({a}, {self.fn(var, body)})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"{'list_transform' if self.duck else 'transform'}({a}, {self.fn(var, body)})"

    def size(self, a: str) -> str:
        return f"len({a})" if self.duck else f"size({a})"

    def any(self, a: str, var: str, body: str) -> str:
        return f"{self.size(self.filter(a, var, body))} > 0"

    def all(self, a: str, var: str, body: str) -> str:
        return f"{self.size(self.filter(a, var, f'NOT ({body})'))} = 0"

    def contains(self, s: str, part: str) -> str:
        return f"contains({s}, {part})"

    def has(self, a: str, x: str) -> str:
        return f"{'list_contains' if self.duck else 'array_contains'}({a}, {x})"

    def common(self, a: str, b: str) -> str:
        return f"{'list_intersect' if self.duck else 'array_intersect'}({a}, {b})"

    def join(self, a: str, sep: str = " ") -> str:
        return f"{'array_to_string' if self.duck else 'array_join'}({a}, '{sep}')"

    def unnest(self, a: str, name: str) -> str:
        """A FROM item after a comma or CROSS JOIN: one row per element, as name.x."""
        return f"LATERAL (SELECT unnest({a}) AS x) {name}" if self.duck else f"LATERAL (SELECT explode({a}) AS x) {name}"

    def terms(self, s: str) -> str:
        """Topic words of a query."""
        words = self.split(self.sub(f"lower(coalesce({s}, ''))", "[^a-z0-9 ]+", " "), " +")
        return self.filter(words, "t", f"length(t) >= 2 AND NOT {self.has(self.strings(STOP_WORDS), 't')}")

    def words(self, s: str) -> str:
        return self.filter(self.split(f"lower(coalesce({s}, ''))", "[^a-z0-9]+"), "w0", "w0 <> ''")

    def mentions(self, text: str, term: str) -> str:
        """Fuzzy presence of a term: an equal word, a shared beginning from 4 letters, or inside the text without spaces from 5."""
        starts = "starts_with" if self.duck else "startswith"
        word = f"(w = {term} OR (length({term}) >= 4 AND {starts}(w, {term})) OR (length(w) >= 4 AND {starts}({term}, w)))"
        return f"({self.any(self.words(text), 'w', word)} OR (length({term}) >= 5 AND {self.contains(self.sub(f'lower(coalesce({text}, {chr(39)*2}))', '[^a-z0-9]+', ''), term)}))"

    def ctr(self, position: str) -> str:
        at = f"greatest(1, least(10, floor({position} + 0.5)))"
        return f"CASE {at} " + " ".join(f"WHEN {p} THEN CAST({c} AS DOUBLE)" for p, c in CTR.items()) + " END"

    def listed(self, x: str, order: str = "") -> str:
        """Sorted array of an aggregate's values."""
        return f"list({x} ORDER BY {order or x})" if self.duck else f"sort_array(collect_list({x}))"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"


class Duck(Dialect):
    duck = True


SPARK, DUCK = Dialect(), Duck()
