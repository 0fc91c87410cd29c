"""Formulas in another language: names, logicals, errors and separators.

A locale is a parameter; ``SPANISH`` is one. Canonical names are understood in
any locale, local ones come first."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..kernel.cells import Err
from .formula import parse, serialise


@dataclass(frozen=True)
class Locale:
    functions: dict[str, str]
    logicals: tuple[str, str] = ("TRUE", "FALSE")
    errors: dict[str, str] = field(default_factory=dict)
    argument: str = ","
    decimal: str = "."
    column: str = ","

    def canonical(self, source: str) -> str:
        """The formula's text with canonical names and separators."""
        back = {v.upper(): k for k, v in self.functions.items()}
        errors = {v.upper(): k for k, v in self.errors.items()}
        number = rf"\d+(?:{re.escape(self.decimal)}\d+)?(?:[eE][+-]?\d+)?"
        token = re.compile(rf'(?P<text>"(?:[^"]|"")*")|(?P<col>\[[^\]]*\])|(?P<sheet>\'(?:[^\']|\'\')*\'!)|(?P<err>#[^\s()+*;,]*[!?]|#[\w/]+)|(?P<name>[^\W\d][\w.]*)|(?P<num>{number})|(?P<open>[{{}}])|(?P<any>.)', re.S)
        out, braces = [], 0
        for m in token.finditer(source):
            kind, s = m.lastgroup, m[0]
            if kind == "err":
                s = errors.get(s.upper(), s)
            elif kind == "num":
                s = s.replace(self.decimal, ".")
            elif kind == "open":
                braces += 1 if s == "{" else -1
            elif kind == "name":
                rest = source[m.end() :].lstrip()
                if rest.startswith("("):
                    s = back.get(s.upper(), s)
                elif s.upper() in self.logicals:
                    s = ("TRUE", "FALSE")[self.logicals.index(s.upper())]
            elif kind == "any":
                s = "," if (s == self.column if braces else s == self.argument) else s
            out.append(s)
        return "".join(out)

    def parse(self, source: str):
        return parse(self.canonical(source))

    def serialise(self, tree) -> str:
        """A tree in this locale's names and separators."""
        kind, t = tree[0], tree
        if kind == "num":
            return serialise(t).replace(".", self.decimal)
        if kind == "bool":
            return self.logicals[0 if t[1] else 1]
        if kind == "err":
            return self.errors.get(t[1], t[1])
        if kind == "array":
            return "{" + ";".join(self.column.join(self.serialise(x) for x in r) for r in t[1]) + "}"
        if kind == "call":
            return f"{self.functions.get(t[1], t[1])}({self.argument.join(self.serialise(a) for a in t[2])})"
        if kind in ("un", "bin"):
            # operands go in as opaque names, so that brackets stay where they must
            held: dict[str, str] = {}

            def opaque(x):
                if x[0] in ("un", "bin"):
                    return (x[0], x[1], *map(opaque, x[2:]))
                name = f"_{len(held)}_"
                held[name] = self.serialise(x)
                return ("name", name)

            return re.sub(r"_\d+_", lambda m: held[m[0]], serialise(opaque(t)))
        return serialise(t)

    def error_text(self, e: Err) -> str:
        return self.errors.get(e.code, e.code)


# Canonical names and their Spanish ones, where these differ.
_SPANISH = """
SUM=SUMA ROUND=REDONDEAR ROUNDUP=REDONDEAR.MAS ROUNDDOWN=REDONDEAR.MENOS SQRT=RAIZ POWER=POTENCIA MOD=RESIDUO INT=ENTERO PRODUCT=PRODUCTO CEILING=MULTIPLO.SUPERIOR FLOOR=MULTIPLO.INFERIOR TRUNC=TRUNCAR SIGN=SIGNO EVEN=REDONDEA.PAR ODD=REDONDEA.IMPAR
SUMPRODUCT=SUMAPRODUCTO SIN=SENO ASIN=ASENO RADIANS=RADIANES DEGREES=GRADOS SQRTPI=RAIZ2PI COMBIN=COMBINAT GCD=M.C.D LCM=M.C.M ROMAN=NUMERO.ROMANO SINH=SENOH ASINH=ASENOH MROUND=REDOND.MULT SUMSQ=SUMA.CUADRADOS DECIMAL=CONV.DECIMAL BITAND=BIT.Y BITOR=BIT.O BITXOR=BIT.XO
BITLSHIFT=BIT.DESPLIZQDA BITRSHIFT=BIT.DESPLDCHA GESTEP=MAYOR.O.IGUAL ARABIC=NUMERO.ARABE AVERAGE=PROMEDIO COUNT=CONTAR COUNTA=CONTARA SUMIF=SUMAR.SI COUNTIF=CONTAR.SI AVERAGEIF=PROMEDIO.SI COUNTIFS=CONTAR.SI.CONJUNTO SUMIFS=SUMAR.SI.CONJUNTO MEDIAN=MEDIANA MODE=MODA STDEV=DESVEST
LARGE=K.ESIMO.MAYOR SMALL=K.ESIMO.MENOR RANK=JERARQUIA STDEVP=DESVESTP AVEDEV=DESVPROM DEVSQ=DESVIA2 GEOMEAN=MEDIA.GEOM HARMEAN=MEDIA.ARMO PERMUT=PERMUTACIONES MAXIFS=MAX.SI.CONJUNTO MINIFS=MIN.SI.CONJUNTO PERCENTILE=PERCENTIL QUARTILE=CUARTIL COUNTBLANK=CONTAR.BLANCO
AVERAGEIFS=PROMEDIO.SI.CONJUNTO CORREL=COEF.DE.CORREL SLOPE=PENDIENTE INTERCEPT=INTERSECCION.EJE FORECAST=PRONOSTICO NORM.DIST=DISTR.NORM.N NORMDIST=DISTR.NORM NORM.INV=INV.NORM NORMINV=DISTR.NORM.INV NORM.S.INV=INV.NORM.ESTAND NORMSINV=DISTR.NORM.ESTAND.INV NORM.S.DIST=DISTR.NORM.ESTAND.N
NORMSDIST=DISTR.NORM.ESTAND SEQUENCE=SECUENCIA UNIQUE=UNICOS SORT=ORDENAR SORTBY=ORDENARPOR FILTER=FILTRAR PMT=PAGO FV=VF PV=VA RATE=TASA IPMT=PAGOINT PPMT=PAGOPRIN NPV=VNA IRR=TIR MIRR=TIRM IF=SI IFS=SI.CONJUNTO AND=Y OR=O XOR=XO NOT=NO TRUE=VERDADERO FALSE=FALSO IFERROR=SI.ERROR
IFNA=SI.ND SWITCH=CAMBIAR LEFT=IZQUIERDA RIGHT=DERECHA MID=EXTRAE LEN=LARGO UPPER=MAYUSC LOWER=MINUSC TRIM=ESPACIOS VALUE=VALOR TEXT=TEXTO FIND=ENCONTRAR SEARCH=HALLAR PROPER=NOMPROPIO CLEAN=LIMPIAR CODE=CODIGO CHAR=CARACTER UNICHAR=UNICAR FIXED=DECIMAL EXACT=IGUAL CONCATENATE=CONCATENAR
SUBSTITUTE=SUSTITUIR REPLACE=REEMPLAZAR REPT=REPETIR TEXTJOIN=UNIRCADENAS DOLLAR=MONEDA TEXTBEFORE=TEXTOANTES TEXTAFTER=TEXTODESPUES TEXTSPLIT=DIVIDIRTEXTO VLOOKUP=BUSCARV HLOOKUP=BUSCARH INDEX=INDICE MATCH=COINCIDIR CHOOSE=ELEGIR ROW=FILA COLUMN=COLUMNA ROWS=FILAS COLUMNS=COLUMNAS
ADDRESS=DIRECCION LOOKUP=BUSCAR FORMULATEXT=FORMULATEXTO XMATCH=COINCIDIRX XLOOKUP=BUSCARX OFFSET=DESREF INDIRECT=INDIRECTO ISBLANK=ESBLANCO ISNUMBER=ESNUMERO ISTEXT=ESTEXTO ISNONTEXT=ESNOTEXTO ISLOGICAL=ESLOGICO ISERROR=ESERROR ISERR=ESERR ISNA=ESNOD ISEVEN=ES.PAR ISODD=ES.IMPAR NA=NOD
ISREF=ESREF TYPE=TIPO ERROR.TYPE=TIPO.DE.ERROR ISFORMULA=ESFORMULA SHEET=HOJA SHEETS=HOJAS TODAY=HOY NOW=AHORA DATE=FECHA YEAR=AÑO MONTH=MES DAY=DIA HOUR=HORA MINUTE=MINUTO SECOND=SEGUNDO TIME=NSHORA WEEKDAY=DIASEM EDATE=FECHA.MES EOMONTH=FIN.MES DAYS=DIAS DAYS360=DIAS360
WEEKNUM=NUM.DE.SEMANA WORKDAY=DIA.LAB NETWORKDAYS=DIAS.LAB YEARFRAC=FRAC.AÑO DATEDIF=SIFECHA
"""
SPANISH = Locale(
    dict(pair.split("=") for pair in _SPANISH.split()), ("VERDADERO", "FALSO"), {"#DIV/0!": "#¡DIV/0!", "#VALUE!": "#¡VALOR!", "#REF!": "#¡REF!", "#NAME?": "#¿NOMBRE?", "#NUM!": "#¡NUM!", "#N/A": "#N/D", "#NULL!": "#¡NULO!", "#SPILL!": "#¡DESBORDAMIENTO!", "#CALC!": "#¡CALC!"}, ";", ",", "\\"
)
