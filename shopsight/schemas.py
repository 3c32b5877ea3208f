"""Declared schemas of the retail tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Money and time arrive as text: decimal commas, no zone.
RAW_TRANSACTIONS = _struct(
    ID_SCONTRINO=T.StringType(), ID_CLI=T.LongType(), ID_NEG=T.LongType(), ID_ARTICOLO=T.LongType(),
    COD_REPARTO=T.IntegerType(), DIREZIONE=T.IntegerType(), IMPORTO_LORDO=T.StringType(),
    SCONTO=T.StringType(), DATETIME=T.StringType(),
)

TRANSACTIONS = _struct(
    ID_SCONTRINO=T.StringType(), ID_CLI=T.LongType(), ID_NEG=T.LongType(), ID_ARTICOLO=T.LongType(),
    COD_REPARTO=T.IntegerType(), DIREZIONE=T.IntegerType(), IMPORTO_LORDO=_MONEY, SCONTO=_MONEY,
    DATETIME=T.TimestampNTZType(),
)

LOYALTY = _struct(
    ID_CLI=T.LongType(), ID_FID=T.LongType(), ID_NEG=T.LongType(), COD_FID=T.StringType(),
    TYP_CLI_FID=T.IntegerType(), STATUS_FID=T.IntegerType(), DT_ACTIVE=T.TimestampNTZType(),
)

ACCOUNTS = _struct(
    ID_CLI=T.LongType(), EMAIL_PROVIDER=T.StringType(), W_PHONE=T.IntegerType(),
    ID_ADDRESS=T.LongType(), TYP_CLI_ACCOUNT=T.IntegerType(), TYP_JOB=T.StringType(),
)

ADDRESSES = _struct(ID_ADDRESS=T.LongType(), CAP=T.StringType())

PRIVACY = _struct(
    ID_CLI=T.LongType(), FLAG_PRIVACY_1=T.IntegerType(), FLAG_PRIVACY_2=T.IntegerType(),
    FLAG_DIRECT_MKT=T.IntegerType(),
)
