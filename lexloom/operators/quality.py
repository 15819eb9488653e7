"""Rule-based quality flags and the split into kept and discarded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Flags in the order in which they are reported; all of them discard.
FLAGS = [
    "alternativas_incompletas", "questoes_mescladas", "depende_de_texto_de_outra_questao", "alternativa_com_texto_extra", "simbolo_nao_convertido",
    "fragmento_solto", "espaco_de_simbolo_perdido", "enunciado_curto", "alternativa_vazia", "depende_de_imagem", "caracteres_estranhos", "sem_gabarito", "questao_anulada",
]
#: Patterns, as fixed values.
ELSEWHERE = (
    "(?iu)descrit[oa]s? anteriormente|apresentad[oa]s? anteriormente|(no|do|pelo) texto [0-9]|(na|da|pela) tabela [0-9]"
    "|situação descrita no texto|quest[ãa]o anterior|mesmo cen[áa]rio"
)
PICTURE = (
    "(?iu)(?<![\\p{L}\\p{N}_])(figura|imagem|ilustra[çc][ãa]o|gr[áa]fico|diagrama|esquema|charge|tirinha|cartum|fotografia|captura de tela)(?![\\p{L}\\p{N}_])"
    "(\\s+[\\p{L}\\p{N}_]+){0,3}\\s+(a seguir|abaixo|acima|seguinte|apresentad|mostrad|exibid|ilustrad)"
    "|(observe|analise|considere)\\s+(a|o)\\s+(figura|imagem|gr[áa]fico|diagrama|esquema)"
)
#: Each match of these patterns holds one of these parts in lower case, or what only case folding makes plain: long s, dotless i,
#: and the dot that a dotted capital I leaves.
ELSEWHERE_PARTS = ["anteriormente", "texto ", "tabela ", "descrita no texto", "o anterior", "mesmo cen"]
PICTURE_PARTS = ["figura", "imagem", "ilustra", "fico", "diagrama", "esquema", "charge", "tirinha", "cartum", "fotografia", "captura de tela"]
FOLDED = ["\u017f", "\u0307", "\u0131"]
UNCONVERTED = "[\\x{E000}-\\x{F8FF}\\x{FFFD}\\x{25A1}]"
LOOSE = "^[0-9()+\\-*/^=−]{1,2}$"
LOST_GAP = f"{T.W} {{2,}}{T.W}"
ORDINARY = "[\\p{L}\\p{N}\\s.,;:!?()\\[\\]{}'\"“”‘’\\-–—/\\\\%$#@&*+=<>_|^~`°ºª§•▪→←≥≤≠×÷⇒⇔±∞√∑∈]"


def flag_array(flags: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())


def unusual(text: Column) -> Column:
    """A text without plain ASCII: the few characters that are left are all that patterns of other characters need to read."""
    return F.regexp_replace(text, "[ -~\n]+", "")


def odd_share(text: Column, left: Column | None = None) -> Column:
    """Share of characters that are neither letters, digits, spaces nor on the list of ordinary signs; 0 for none. left: ``unusual``."""
    left = unusual(text) if left is None else left
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(left, ORDINARY + "+", "")) / F.length(text)).otherwise(F.lit(0.0))


def _found(text: Column, pattern: str, lower: Column, parts: list[str]) -> Column:
    """Whether the pattern is in a text; it is looked for only where one of the parts is."""
    return F.when(T.holds_any(lower, parts + FOLDED), F.regexp_like(text, F.lit(pattern))).otherwise(F.lit(False))


def _lost_gap(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("  ")), F.regexp_like(text, F.lit(LOST_GAP))).otherwise(F.lit(False))


def flagged(df: DataFrame) -> DataFrame:
    """Add ``problems`` to split questions: statement, options (lines), merged, received_context, n_options, answer."""
    letters = F.array_sort(F.map_keys("options"))
    due = F.slice(F.array(*map(F.lit, "ABCDE")), F.lit(1), F.col("n_options"))
    folded = F.transform(F.map_values("options"), lambda v: T.without_footer(T.fold_lines(v)))
    every = F.concat("statement", F.flatten(F.map_values("options")))
    work = df.withColumns({"_f": folded, "_every": every, "_statement": T.without_footer(T.fold_lines("statement"))}).withColumns(
        {"_sizes": F.array_sort(F.transform("_f", F.length)), "_text": F.array_join("_every", " ")}
    ).withColumns({"_lower": F.lower("_text"), "_left": unusual(F.col("_text"))})
    longest = F.try_element_at("_sizes", F.lit(-1))
    middle = F.try_element_at("_sizes", (F.floor(F.size("_sizes") / 2) + 1).cast("int"))
    rules = [
        ~letters.eqNullSafe(due), F.col("merged"), _found(F.array_join("statement", " "), ELSEWHERE, F.col("_lower"), ELSEWHERE_PARTS) & ~F.col("received_context"),
        (longest > 250) & (longest > 4 * F.greatest(middle, F.lit(20))), F.regexp_like("_left", F.lit(UNCONVERTED)),
        F.exists("_every", lambda x: F.regexp_like(x, F.lit(LOOSE))), _lost_gap(F.col("_text")), F.length("_statement") < 25,
        F.exists("_f", lambda x: x == ""), _found(F.col("_text"), PICTURE, F.col("_lower"), PICTURE_PARTS), odd_share(F.col("_text"), F.col("_left")) > 0.03,
        F.col("answer").isNull(), F.col("answer") == "ANULADA",
    ]
    return work.withColumn("problems", flag_array(list(zip(FLAGS, rules)))).drop("_f", "_every", "_statement", "_sizes", "_text", "_lower", "_left")


def text_flags(text: Column | str = "text") -> Column:
    """The flags that any text can have, by line or as a whole."""
    c = T.col(text)
    return flag_array([
        ("alternativa_com_texto_extra", F.regexp_like(c, F.lit("(?md)^[^\n]{2001}"))), ("simbolo_nao_convertido", F.regexp_like(unusual(c), F.lit(UNCONVERTED))),
        ("fragmento_solto", F.regexp_like(c, F.lit(f"(?md){LOOSE}"))), ("espaco_de_simbolo_perdido", _lost_gap(c)),
        ("enunciado_curto", F.length(c) < 25), ("depende_de_imagem", _found(c, PICTURE, F.lower(c), PICTURE_PARTS)), ("caracteres_estranhos", odd_share(c) > 0.03),
    ])


def branched(df: DataFrame, reasons: str, discard: list[str] = FLAGS) -> DataFrame:
    """Rows with ``branch``, kept or discarded, and the reasons in ``discard`` alone: both branches by one evaluation."""
    cut = df.withColumn(reasons, F.array_intersect(reasons, F.array(*map(F.lit, discard))))
    return cut.withColumn("branch", F.when(F.size(reasons) == 0, "kept").otherwise("discarded"))


def keep_discard(df: DataFrame, reasons: str, discard: list[str] = FLAGS) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): rows without and with a reason in ``discard``; the discarded keep those reasons, in order."""
    cut = branched(df, reasons, discard)
    return cut.where("branch = 'kept'").drop("branch"), cut.where("branch = 'discarded'").drop("branch")
