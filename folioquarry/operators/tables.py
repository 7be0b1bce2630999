"""Tables as grids: array<array<struct<cell_id,text,bold,shaded,image>>>, predicates as array functions, kinds and header guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import after_first, is_amount, let, parse_number

GRID = "array<array<struct<cell_id:int,text:string,bold:boolean,shaded:boolean,image:boolean>>>"


def row(grid: Column, i: int) -> Column:
    return F.get(grid, F.lit(i))


def column(grid: Column, j: int | Column) -> Column:
    return F.transform(grid, lambda r: F.get(r, F.lit(j) if isinstance(j, int) else j))


def texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))))


def filled(cells: Column) -> Column:
    return F.filter(texts(cells), lambda t: t != "")


def is_full_width_band(cells: Column) -> Column:
    """One merged cell with text spans the row."""
    return (F.size(cells) > 1) & (F.size(F.array_distinct(F.transform(cells, lambda c: c["cell_id"]))) == 1) & (F.size(filled(cells)) > 0)


def looks_like_header_band(cells: Column, blank_corner: bool = False) -> Column:
    """Every cell has text and is bold, or every one shaded; a blank first cell may be passed over."""
    own = F.when(F.lit(blank_corner) & (F.size(cells) > 1) & (F.get(texts(cells), F.lit(0)) == ""), after_first(cells)).otherwise(cells)
    return (F.size(own) > 0) & F.forall(own, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "") & (F.forall(own, lambda c: F.coalesce(c["bold"], F.lit(False))) | F.forall(own, lambda c: F.coalesce(c["shaded"], F.lit(False))))


def _numeric(t: Column) -> Column:
    return t.rlike(r"^[\d\s.,%$€£()+\-−/]*\d[\d\s.,%$€£()+\-−/]*$")


def mostly_numeric(cells: Column) -> Column:
    """Three in five filled cells are numbers, the bound cut to a whole number but one at least."""
    t = filled(cells)
    return (F.size(t) > 0) & (F.size(F.filter(t, _numeric)) >= F.greatest(F.lit(1), (F.size(t) * 0.6).cast("int")))


def mostly_values(cells: Column, ratio: float = 0.8) -> Column:
    t = filled(cells)
    return (F.size(t) > 0) & (F.size(F.filter(t, is_amount)) >= ratio * F.size(t))


def keys_rows(cells: Column) -> Column:
    """A filled column of distinct texts that are labels (a fifth no numbers), or three numbers at least that only rise or only fall."""
    t = texts(cells)
    numbers = F.array_compact(F.transform(t, parse_number))
    other = F.size(t) - F.size(numbers)
    tail = after_first(numbers)
    pairs = lambda f: F.forall(F.zip_with(F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))), tail, f), lambda x: x)
    rises = (F.size(numbers) >= 3) & (pairs(lambda a, b: a < b) | pairs(lambda a, b: a > b))
    return (F.size(t) > 0) & F.forall(t, lambda x: x != "") & (F.size(F.array_distinct(t)) == F.size(t)) & ((other >= 0.2 * F.size(t)) | rises)


def plain_grid(grid: Column) -> Column:
    t = filled(F.flatten(grid))
    return (F.size(t) > 0) & F.forall(t, is_amount)


def snaked_list(grid: Column, least: int = 6, longest: int = 40) -> Column:
    """Short terms in alphabetical order down the columns, then across."""
    width = F.size(row(grid, 0))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: column(grid, j)))
    t = F.transform(filled(cells), F.lower)
    return (F.size(t) >= least) & F.forall(t, lambda x: (F.length(x) <= longest) & ~x.rlike(r"\d")) & (F.array_sort(t) == t)


def text_over_numbers(grid: Column) -> Column:
    """The first row in words, and every filled cell below but for the first column a number."""
    below = F.flatten(F.transform(after_first(grid), lambda r: after_first(r)))
    head = filled(row(grid, 0))
    return (F.size(grid) > 1) & (F.size(head) > 0) & F.forall(head, lambda x: ~_numeric(x)) & (F.size(filled(below)) > 0) & F.forall(filled(below), _numeric)


def blank_corner_matrix(grid: Column) -> Column:
    """A blank corner, labels along both edges, and all of the body filled."""
    top, left = after_first(texts(row(grid, 0))), after_first(texts(column(grid, 0)))
    body = texts(F.flatten(F.transform(after_first(grid), lambda r: after_first(r))))
    return (F.size(grid) > 1) & (F.size(row(grid, 0)) > 1) & (F.get(texts(row(grid, 0)), F.lit(0)) == "") & F.forall(top, lambda x: x != "") & F.forall(left, lambda x: x != "") & F.forall(body, lambda x: x != "")


def label_value(grid: Column, longest: int = 40) -> Column:
    """Two columns: a short label that is no amount, and a longer text or an amount."""
    pair = lambda r: F.length(F.get(texts(r), F.lit(0))).between(1, longest) & ~is_amount(F.get(texts(r), F.lit(0))) & (is_amount(F.get(texts(r), F.lit(1))) | (F.length(F.get(texts(r), F.lit(1))) > F.length(F.get(texts(r), F.lit(0)))))
    return (F.size(grid) > 0) & F.forall(grid, lambda r: (F.size(r) == 2) & F.coalesce(pair(r), F.lit(False)))


def header_like(cells: Column, below: Column, longest: int = 40) -> Column:
    """Short distinct labels without numbers over a row of longer texts or numbers."""
    t, u = texts(cells), texts(below)
    short = F.forall(t, lambda x: (x != "") & (F.length(x) <= longest) & ~_numeric(x)) & (F.size(F.array_distinct(t)) == F.size(t))
    return short & (F.exists(u, _numeric) | (F.length(F.array_join(u, "")) > F.length(F.array_join(t, ""))))


def holds_values(grid: Column) -> Column:
    """The body as a whole, or one of its columns, is mostly values."""
    body = after_first(grid)
    columns = F.sequence(F.lit(1), F.greatest(F.size(row(grid, 0)) - 1, F.lit(1)))
    return mostly_values(F.flatten(F.transform(body, lambda r: after_first(r)))) | F.exists(columns, lambda j: mostly_values(column(body, j)))


def table_digest(cells: Column) -> Column:
    """SHA-256 of all cell texts (an array of rows of texts), row by row, and of the shape."""
    body = F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda x: F.trim(x)), "\x1f")), "\x1e")
    shape = F.concat(F.size(cells).cast("string"), F.lit("x"), F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)).cast("string"))
    return F.sha2(F.concat(body, F.lit("\x1d"), shape), 256)


def table_key(grid: Column) -> Column:
    """The digest of a grid."""
    return table_digest(F.transform(grid, texts))


def classify(df: DataFrame, grid: str = "grid", marked: str | None = None) -> DataFrame:
    """kind of each table, by the first rule that holds; ``marked``: whether row 1 repeats as a heading."""
    g = F.col(grid)
    cells = F.flatten(g)
    mark = F.coalesce(F.col(marked), F.lit(False)) if marked else F.lit(False)
    words = F.size(filled(cells)) > 0
    pictures = F.exists(cells, lambda c: F.coalesce(c["image"], F.lit(False)))
    title = is_full_width_band(row(g, 0))
    headed = F.transform(g, lambda r, i: ~is_full_width_band(r) & F.when(i == 0, looks_like_header_band(r, True)).otherwise(looks_like_header_band(r)))
    row1 = F.coalesce(F.get(headed, F.lit(0)), F.lit(False)) | mark
    row2 = F.coalesce(F.get(headed, F.lit(1)), F.lit(False))
    left = after_first(column(g, 0))
    column1 = (F.size(left) > 0) & looks_like_header_band(left) & ~mostly_numeric(left)
    later = F.exists(after_first(headed), lambda x: x)
    kind = (
        F.when(F.coalesce(F.size(g), F.lit(0)) <= 0, "empty").when(pictures & ~words, "layout(image-only)").when((F.size(g) == 1) & (F.size(row(g, 0)) == 1), "layout(single-cell)")
        .when(title & (row2 | mark), "title-row-then-headers").when(row1 & column1, "both").when(row1, "first-row").when(column1, "first-column").when(later, "headers-not-in-row-1").otherwise("no-header-signal")
    )
    return df.withColumn("kind", kind).withColumn("n_rows", F.greatest(F.size(g), F.lit(0))).withColumn("n_columns", F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0)))


def _guess(g: Column, kind: Column, has_head: Column, body: Column) -> Column:
    keyed = keys_rows(column(body, 0)) & holds_values(g)
    small = (F.size(row(g, 0)) < 2) | (F.size(body) < 2)
    fallback = F.when(plain_grid(g) | snaked_list(g), "none").otherwise("unknown")
    return (
        F.when(kind.startswith("layout") | (kind == "empty"), F.lit(None)).when(~has_head & (kind == "headers-not-in-row-1"), "unknown").when(kind == "both", "both").when(kind == "first-column", "first-column")
        .when(blank_corner_matrix(g), "both").when(~has_head & label_value(g), "first-column").when(small, F.when(has_head, "first-row").otherwise(fallback))
        .when(~keyed, F.when(has_head, "first-row").otherwise(fallback)).when(has_head, "both").when(~mostly_values(column(body, 0)), "first-column").otherwise(fallback)
    )


def explain(df: DataFrame, grid: str = "grid") -> DataFrame:
    """guess of a classified table's headers: both, first-row, first-column, none, unknown, or null for no data table.

    The grid without a title's bands, its body and whether it has a head are each computed once.
    """
    bands = F.filter(F.col(grid), lambda r: ~is_full_width_band(r) & (F.size(filled(r)) > 0))
    g = F.when(is_full_width_band(row(F.col(grid), 0)), bands).otherwise(F.col(grid))
    headed = lambda x: F.struct(x.alias("g"), after_first(x).alias("body"), (F.col("kind").isin("both", "first-row", "title-row-then-headers") | text_over_numbers(x)).alias("head"))
    guess = let(let(g, headed), lambda s: _guess(s["g"], F.col("kind"), s["head"], s["body"]))
    return df.withColumn("guess", guess)


def structure(df: DataFrame, grid: str = "grid") -> DataFrame:
    """caption_rows and split_at (1-based lists as text): full-width bands that title the table, or split it."""
    g = F.col(grid)
    band = F.transform(g, lambda r: F.coalesce(is_full_width_band(r), F.lit(False)))
    at = F.filter(F.transform(band, lambda b, i: F.when(b & F.exists(F.slice(band, i + 2, F.size(band)), lambda x: ~x), i + 1)), lambda x: x.isNotNull())
    adjacent = F.size(F.filter(at, lambda i: F.array_contains(at, i + 1)))
    joined = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    first_two = F.array_contains(at, 1) & F.array_contains(at, 2) & (adjacent == 1)
    only_first = joined(at) == "1"
    captions = F.when(first_two | only_first, F.lit("1")).otherwise("")
    splits = F.when(only_first, "").when(first_two, joined(F.filter(at, lambda i: i != 1))).otherwise(joined(at))
    return df.withColumn("caption_rows", captions).withColumn("split_at", splits)


def census(tables: DataFrame, book: str = "book") -> DataFrame:
    """Tallies by kind, by guess and by book from one pass of grouping sets."""
    sets = tables.groupingSets([["kind"], ["guess"], [book]], "kind", "guess", book).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    by = F.when(F.col("gid") == 3, "kind").when(F.col("gid") == 5, "guess").otherwise("book")
    return sets.select(by.alias("by"), F.coalesce(F.when(F.col("gid") == 3, F.col("kind")).when(F.col("gid") == 5, F.col("guess")).otherwise(F.col(book)), F.lit("-")).alias("value"), "n")


def vote(parts: DataFrame, key: list[str], whole: str, guess: str = "guess", order: str = "part") -> DataFrame:
    """The guess of most parts; a tie goes to the whole's, else the first part's that is not none."""
    per = parts.groupBy(*key, guess).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(whole).alias("whole"))
    rank = F.struct((-F.col("n")).alias("a"), (F.col(guess) != F.col("whole")).cast("int").alias("b"), (F.col(guess) == "none").cast("int").alias("c"), F.col("first").alias("d"))
    return per.groupBy(*key).agg(F.min_by(guess, rank).alias("value"))


def sentence_across(cells: Column) -> Column:
    """A full-width row that ends as a sentence does."""
    return is_full_width_band(cells) & F.coalesce(F.get(texts(cells), F.lit(0)).rlike(r"""[.!?]["'”’)\]]*$"""), F.lit(False))


ATTRIBUTION = r"(?i)^(source|sources|adapted from|data from|based on|from|credit|note)\b"


def note_body(grid: Column) -> Column:
    """The grid without the closing full-width lines that say where it comes from."""
    own = F.transform(grid, lambda r: is_full_width_band(r) & F.get(texts(r), F.lit(0)).rlike(ATTRIBUTION))
    last = F.array_max(F.transform(own, lambda x, i: F.when(~F.coalesce(x, F.lit(False)), i)))
    return F.slice(grid, F.lit(1), F.coalesce(last + 1, F.lit(0)))


def note_rows(grid: Column) -> Column:
    """Places (from 1) of full-width sentences that are notes on the rows above them, if the table ends with one and does not begin with one."""
    body = note_body(grid)
    note = F.transform(body, lambda r, i: (i > 0) & F.coalesce(sentence_across(r), F.lit(False)) & ~F.coalesce(is_full_width_band(F.get(body, i - 1)), F.lit(False)))
    opens = F.coalesce(sentence_across(F.get(body, F.lit(0))), F.lit(False))
    at = F.array_compact(F.transform(note, lambda x, i: F.when(x, i + 1)))
    return F.when((F.size(body) > 0) & ~opens & F.array_contains(at, F.size(body)), at).otherwise(F.array().cast("array<int>"))


def repeated_header_rows(grid: Column) -> Column:
    """Places (from 1) of header rows that repeat row 1 but for their first cell, row 1 among them; each heads a row at least."""
    tail = lambda r: after_first(texts(r))
    first = row(grid, 0)
    several = lambda r: F.size(F.array_distinct(F.transform(r, lambda c: c["cell_id"]))) > 1
    like = F.transform(grid, lambda r, i: (i == 0) | (several(r) & looks_like_header_band(r) & (tail(r) == tail(first)) & (F.get(texts(r), F.lit(0)) != F.get(texts(first), F.lit(0)))))
    at = F.array_compact(F.transform(like, lambda x, i: F.when(x, i + 1)))
    apart = F.forall(F.transform(at, lambda x, i: F.when(i == 0, 2).otherwise(x - F.get(at, i - 1))), lambda d: d > 1) & (F.element_at(at, -1) < F.size(grid))
    fit = (F.size(grid) >= 4) & several(first) & looks_like_header_band(first) & (F.size(at) > 1) & apart
    return F.when(F.coalesce(fit, F.lit(False)), at).otherwise(F.array().cast("array<int>"))


def without_header_column(guess: Column, kind: Column, grid: Column, marked: Column) -> Column:
    """A guess once notes between the rows rule out a header column; ``marked``: whether the source marks a header row."""
    notes = note_rows(grid)
    inner = F.size(F.filter(notes, lambda i: i < F.size(note_body(grid)))) > 0
    down = F.when((guess == "both") | ((guess == "first-column") & marked), "first-row").when(~marked & ((guess == "first-column") | ((guess == "unknown") & ~kind.startswith("headers-not-in-row-1"))), "none").otherwise(guess)
    return F.when(guess.isNotNull() & inner, down).otherwise(guess)


def one_cell(grid: Column) -> Column:
    return (F.size(grid) == 1) & (F.size(row(grid, 0)) == 1)


def lines_to_fill(grid: Column) -> Column:
    """Every cell with text holds a line to write on, or a number or letter that leads one; one line at least."""
    t = filled(F.flatten(grid))
    return F.exists(t, lambda x: x.rlike(r"^_{3,}$")) & F.forall(t, lambda x: x.rlike(r"^(\(?[0-9A-Za-z]{1,2}[.)]?\s*)?_{3,}$|^\(?[0-9A-Za-z]{1,2}[.)]$"))


def pictures_alone(grid: Column, longest: int = 40) -> Column:
    """Rows of pictures, with rows of short labels or none between them."""
    pictured = F.transform(grid, lambda r: F.exists(r, lambda c: F.coalesce(c["image"], F.lit(False))))
    labels = F.forall(F.flatten(grid), lambda c: F.coalesce(c["image"], F.lit(False)) | (F.length(F.trim(F.coalesce(c["text"], F.lit("")))) <= longest))
    gaps = F.forall(F.transform(pictured, lambda x, i: x | F.coalesce(F.get(pictured, i - 1), F.lit(False)) | F.coalesce(F.get(pictured, i + 1), F.lit(False))), lambda x: x)
    return F.exists(pictured, lambda x: x) & labels & gaps


def matching_exercise(grid: Column) -> Column:
    """Two lists side by side to be matched: numbers lead the first column, letters the second."""
    lead = lambda j, form: F.forall(filled(column(grid, j)), lambda x: x.rlike(form)) & (F.size(filled(column(grid, j))) > 1)
    return F.forall(grid, lambda r: F.size(r) == 2) & lead(0, r"^\(?[0-9]{1,2}[.)]\s") & lead(1, r"^\(?[A-Za-z][.)]\s")


def layout_reason(grid: Column, headed: Column, organizer: Column, captioned: Column, placed: Column) -> Column:
    """Why a table is layout only: shape, page (an organizer's) or place (where it stands); null for a data table.

    headed: whether it declares headers; placed: whether its place or class says layout.
    """
    shape = one_cell(grid) | lines_to_fill(grid) | pictures_alone(grid) | matching_exercise(grid)
    return F.when(headed, F.lit(None)).when(F.coalesce(shape, F.lit(False)), "shape").when(organizer, "page").when(~captioned & placed, "place")
