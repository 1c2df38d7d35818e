"""Units of measurement to canonical ones, as a lookup of factors and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit as normalised -> canonical unit, factor, offset.
UNITS: dict[str, tuple[str, float, float]] = {
    # pressure
    "МПа": ("МПа", 1.0, 0.0), "кПа": ("МПа", 1e-3, 0.0), "ГПа": ("МПа", 1e3, 0.0), "гПа": ("МПа", 1e-4, 0.0), "мПа": ("МПа", 1e-9, 0.0),
    "Па": ("МПа", 1e-6, 0.0), "атм": ("МПа", 0.101325, 0.0), "бар": ("МПа", 0.1, 0.0), "мбар": ("МПа", 1e-4, 0.0),
    "psi": ("МПа", 0.006894757293168361, 0.0), "кгс/см2": ("МПа", 0.0980665, 0.0),
    # temperature
    "°C": ("°C", 1.0, 0.0), "K": ("°C", 1.0, -273.15), "К": ("°C", 1.0, -273.15),
    # length
    "мкм": ("мм", 1e-3, 0.0), "нм": ("мм", 1e-6, 0.0), "см": ("мм", 10.0, 0.0), "мм": ("мм", 1.0, 0.0),
    # flow of volume
    "м3/ч": ("м³/ч", 1.0, 0.0), "л/ч": ("м³/ч", 1e-3, 0.0), "л/с": ("м³/ч", 3.6, 0.0), "л/мин": ("м³/ч", 0.06, 0.0),
    "м3/с": ("м³/ч", 3600.0, 0.0), "м3/сут": ("м³/ч", 1 / 24, 0.0),
    # speed
    "м/с": ("м/с", 1.0, 0.0), "км/ч": ("м/с", 1 / 3.6, 0.0), "мм/с": ("м/с", 1e-3, 0.0),
    # concentration
    "мг/л": ("мг/л", 1.0, 0.0), "мг/дм3": ("мг/л", 1.0, 0.0), "мкг/л": ("мг/л", 1e-3, 0.0), "мкг/дм3": ("мг/л", 1e-3, 0.0), "ppm": ("мг/л", 1.0, 0.0),
    "г/л": ("г/л", 1.0, 0.0), "г/дм3": ("г/л", 1.0, 0.0),
    "моль/л": ("моль/л", 1.0, 0.0), "моль/дм3": ("моль/л", 1.0, 0.0), "ммоль/л": ("моль/л", 1e-3, 0.0), "М": ("моль/л", 1.0, 0.0),
    # mass ratio
    "г/т": ("г/т", 1.0, 0.0), "кг/т": ("г/т", 1e3, 0.0), "мг/т": ("г/т", 1e-3, 0.0),
    # per cent
    "%": ("%", 1.0, 0.0), "мас.%": ("%", 1.0, 0.0), "масс.%": ("%", 1.0, 0.0), "об.%": ("%", 1.0, 0.0), "%масс": ("%", 1.0, 0.0), "%мас": ("%", 1.0, 0.0), "%об": ("%", 1.0, 0.0),
    # flow of mass
    "т/сут": ("т/сут", 1.0, 0.0), "кг/сут": ("т/сут", 1e-3, 0.0), "т/год": ("т/год", 1.0, 0.0), "т/ч": ("т/ч", 1.0, 0.0), "кг/ч": ("т/ч", 1e-3, 0.0),
    # current density
    "А/м2": ("А/м²", 1.0, 0.0), "кА/м2": ("А/м²", 1e3, 0.0), "А/дм2": ("А/м²", 100.0, 0.0), "А/см2": ("А/м²", 1e4, 0.0), "мА/см2": ("А/м²", 10.0, 0.0),
    # rotation, energy, money, volume
    "об/мин": ("об/мин", 1.0, 0.0), "об/с": ("об/мин", 60.0, 0.0), "rpm": ("об/мин", 1.0, 0.0),
    "кВт*ч/т": ("кВт·ч/т", 1.0, 0.0), "kWh/t": ("кВт·ч/т", 1.0, 0.0), "МВт*ч/т": ("кВт·ч/т", 1e3, 0.0),
    "USD/t": ("USD/t", 1.0, 0.0), "USD/т": ("USD/t", 1.0, 0.0), "$/т": ("USD/t", 1.0, 0.0), "$/t": ("USD/t", 1.0, 0.0),
    "м3": ("м³", 1.0, 0.0), "л": ("л", 1.0, 0.0), "мл": ("л", 1e-3, 0.0),
}
SIGNS = ("²³¹⁻·∙×℃", "231-***")


def normal_unit(c: Column) -> Column:
    """One spelling for each unit; case stays, as it tells prefixes apart."""
    u = F.regexp_replace(c, "[ \\u00a0\\u202f]", "")
    u = F.replace(u, F.lit("℃"), F.lit("°C"))
    u = F.translate(u, SIGNS[0][:7], SIGNS[1])
    u = F.replace(u, F.lit("°С"), F.lit("°C"))
    return F.regexp_replace(u, "млн[-−]1", "ppm")


def _lookup(c: Column, place: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[place])])[normal_unit(c)]


def canonical_unit(unit: Column) -> Column:
    """The canonical unit; an unknown one stays."""
    return F.coalesce(_lookup(unit, 0), unit)


def canonical_value(value: Column, unit: Column) -> Column:
    """The value in the canonical unit, rounded to 10 digits; in an unknown unit it stays."""
    return F.coalesce(F.bround(value * _lookup(unit, 1) + _lookup(unit, 2), 10), value)


def canonical_width(value: Column, unit: Column) -> Column:
    """A tolerance or distance in the canonical unit: the factor without the offset."""
    return F.coalesce(F.bround(value * _lookup(unit, 1), 10), value)
