"""Ordered lines: every operator keeps (key, line_no) explicit, so that order survives distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

PAGE = "\f"
#: Watermarks and page numbers, options, page footers.
NOISE = "^(pcimarkpci(?![\\p{L}\\p{N}_]).*|www\\.pciconcursos\\.com\\.br|FGV Conhecimento|Página [0-9]+( de [0-9]+)?)$"
OPTION = "^\\(([A-E])\\)\\s*(.*)$"
FOOTER = "(Tipo|Prova)\\s*[0-9].*P[áa]gina\\s*[0-9]+|TIPO .*P[ÁA]GINA [0-9]+|^P[áa]gina\\s*[0-9]+|^Realização$"
#: How section titles begin, what they hold not, and what stands before them.
TITLE_BEGINS = (
    "^(M\\s?[ÓO]DULO\\b|C\\s?ONHECIMENTOS\\b|Conhecimentos\\b|L[ÍI]NGUA\\b|L[íi]ngua\\b|Racioc[íi]nio|RACIOC|Legisla[çc][ãa]o|LEGISLA|No[çc][õo]es|NO[ÇC][ÕO]ES"
    "|Direitos?\\b|DIREITO|Hist[óo]ria|Matem[áa]tica|Atualidades|[ÉE]tica\\b|Governan[çc]a|Seguran[çc]a da Informa[çc][ãa]o|Arquitetura de Sistemas"
    "|Engenharia de Software|Banco de Dados|Fundamentos de|Controle Externo|Auditoria|Administra[çc][ãa]o|Filosofia|Estat[íi]stica|Normas|Organiza[çc][ãa]o do"
    "|T\\. ?I\\. ?-|Processos de Neg|Desenvolvimento de Sistemas|Infraestrutura|Redes de Computadores|Ci[êe]ncia de Dados)"
)
TITLE_VERB = "\\s(é|são|que|foi|pelo|pela|utilizado|utilizada|publicado|podem|pode)\\b"
BEFORE_TITLE = "[.;:!?)”\"]$|^[0-9]+$|^\\(E\\)|P[ÁA]GINA|Página|^[A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 ()/–-]+$"


def ordered(key: str) -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def lines(docs: DataFrame, key: str, text: str | Column = "text") -> DataFrame:
    """(key, line_no, text): the lines of each text."""
    return docs.select(key, F.posexplode(F.split(T.col(text), "\n")).alias("line_no", "text"))


def page_lines(docs: DataFrame, key: str, text: str | Column = "text") -> DataFrame:
    """Trimmed lines with symbols mapped; a page break is a line of its own; blank and glyph-only lines are gone."""
    broken = F.regexp_replace(T.symbols(text), "(?m)^([^\\n\\f]*)\\f", "\f\n$1")
    split = docs.select(key, F.posexplode(F.split(broken, "\n")).alias("line_no", "text"))
    kept = split.withColumn("text", F.when(F.contains("text", F.lit(PAGE)), F.lit(PAGE)).otherwise(F.trim(F.regexp_replace("text", "^\\s+|\\s+$", ""))))
    return kept.where((F.col("text") == PAGE) | ((F.col("text") != "") & ~F.regexp_like("text", F.lit("^[\\x{E000}-\\x{F8FF}\\s]+$"))))


def without_noise(df: DataFrame) -> DataFrame:
    """Watermarks, site names, page numbers and empty lines removed."""
    return df.where((F.trim("text") != "") & ~F.regexp_like("text", F.lit(f"(?iu){NOISE}")))


def without_headers(df: DataFrame, key: str, often: int = 4, longer: int = 15) -> DataFrame:
    """Page footers, and lines longer than ``longer`` that a document repeats ``often`` times, removed; options, numbers and page breaks stay."""
    plain = ~F.regexp_like("text", F.lit(OPTION)) & ~T.is_digits("text") & (F.col("text") != PAGE)
    repeated = df.where(plain & (F.length("text") > longer)).groupBy(key, "text").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= often)
    footer = F.regexp_like("text", F.lit(f"(?iu){FOOTER}")) & (F.col("text") != PAGE)
    return df.where(~footer).join(repeated.drop("_n"), [key, "text"], "left_anti").select(*df.columns)


def renumbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def split_glued_numbers(df: DataFrame, key: str) -> DataFrame:
    """A number of up to three digits glued to a sentence's end becomes a line of its own."""
    pattern = "^(.{3,}[.;:)”\"?!])([0-9]{1,3})$"
    parts = F.when(F.regexp_like("text", F.lit(pattern)), F.array(F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))).otherwise(F.array("text"))
    out = df.select(*[c for c in df.columns if c != "text"], F.posexplode(parts).alias("_part", "text"))
    return renumbered(out, key, "line_no", "_part").drop("_part")


def forward_filled(df: DataFrame, key: str, mark: Column, value: Column, name: str) -> DataFrame:
    """The last marked value strictly before each line (as-of join, backward)."""
    before = ordered(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(before))


def islands(df: DataFrame, key: str, start: Column, name: str = "island") -> DataFrame:
    """Number the stretches that begin at ``start`` lines; 0 before the first."""
    return df.withColumn(name, F.sum(start.cast("int")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))


def titled(df: DataFrame, key: str) -> DataFrame:
    """Add ``title`` (of a line that is a section title, with its second line) and ``in_title`` (lines of titles)."""
    w = ordered(key)
    prev, after = F.lag("text").over(w), F.coalesce(F.lead("text").over(w), F.lit(""))
    is_title = (
        F.regexp_like("text", F.lit(f"(?U){TITLE_BEGINS}")) & (F.length("text") <= 70) & ~F.regexp_like("text", F.lit("[.:;?,)(]"))
        & (F.size(F.split(F.trim("text"), "\\s+")) <= 8) & ~F.regexp_like("text", F.lit(f"(?U){TITLE_VERB}"))
        & (prev.isNull() | (prev == PAGE) | F.regexp_like(prev, F.lit(BEFORE_TITLE)))
    )
    two = (F.regexp_like("text", F.lit("(?iu)\\s(e|de|do|da|dos|das|em)$")) | F.regexp_like(after, F.lit("^\\p{Ll}"))) & (F.length(after) < 60) & ~F.regexp_like(after, F.lit("[.:;?]$"))
    out = df.withColumn("_title", F.coalesce(is_title, F.lit(False))).withColumn("_two", F.col("_title") & two)
    out = out.withColumn("title", F.when(F.col("_two"), F.concat("text", F.lit(" "), after)).when(F.col("_title"), F.col("text")))
    return out.withColumn("in_title", F.col("_title") | F.coalesce(F.lag("_two").over(w), F.lit(False))).drop("_title", "_two")


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Add ``place``, the order of blocks on a two-column page: full-width ones above, left column, right, full-width ones below.

    blocks: page columns, width, x_min, y_min, x_max; blocks at one place go by ``block``, their place in the
    source, where there is one, else by x_max.
    """
    half = F.col("width") / 2
    column = F.when(F.col("x_max") <= half + 15, 1).when(F.col("x_min") >= half - 15, 2).otherwise(0)
    top = F.coalesce(F.min(F.when(F.col("column") > 0, F.col("y_min"))).over(Window.partitionBy(*page)), F.lit(1e9))
    band = F.when(F.col("column") > 0, F.col("column")).when(F.col("y_min") < F.col("top"), 0).otherwise(3)
    placed = blocks.withColumn("column", column).withColumn("top", top).withColumn("band", band)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("band", "y_min", "x_min", "block" if "block" in blocks.columns else "x_max"))).drop("top", "band", "column")
