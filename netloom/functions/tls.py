"""TLS fingerprint text.

These are the sensor's own formats, not the published JA3/JA4: JA3 has three
fields, and the client's extension list is inferred from what the connection
shows instead of being read from the handshake.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension numbers of the TLS registry, and TLS 1.3.
SERVER_NAME = "0"
SUPPORTED_GROUPS = "10"
SIGNATURE_ALGORITHMS = "13"
ALPN = "16"
SESSION_TICKET = "35"
SUPPORTED_VERSIONS = "43"
KEY_SHARE = "51"
TLS13 = 0x0304


def client_extensions(
    version: Column, server_name: Column, resumed: Column, curve: Column, next_protocol: Column
) -> Column:
    """Extension numbers as text, in their fixed order."""
    modern = version >= TLS13

    def present(text: Column) -> Column:
        return text.isNotNull() & (text != "")

    return F.array_compact(
        F.array(
            F.when(server_name.isNotNull(), F.lit(SERVER_NAME)),
            F.when(resumed, F.lit(SESSION_TICKET)),
            F.when(present(curve), F.lit(SUPPORTED_GROUPS)),
            F.when(modern, F.lit(SIGNATURE_ALGORITHMS)),
            F.when(modern, F.lit(KEY_SHARE)),
            F.when(modern, F.lit(SUPPORTED_VERSIONS)),
            F.when(present(next_protocol), F.lit(ALPN)),
        )
    )


def ja3(version: Column, ciphers: Column, extensions: Column) -> Column:
    return F.concat_ws(",", version, F.array_join(ciphers, "-"), F.array_join(extensions, "-"))


def ja4(version: Column, ciphers: Column, extensions: Column, user_agent: Column) -> Column:
    agent = F.when(user_agent == "", F.lit("0")).otherwise(F.md5(user_agent))
    return F.concat(
        F.lit("t"),
        F.concat_ws("_", version, F.array_join(ciphers, "-"), F.array_join(extensions, "-"), agent),
    )


def ja4s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.concat(F.lit("t"), F.concat_ws("_", version, cipher, F.array_join(extensions, "-")))
