"""Tokens, chains and addresses: helpers from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chains and token standards.
EVM_CHAINS = ["eip155:1", "eip155:11155111"]
TEZOS_CHAINS = ["tezos:mainnet", "tezos:ghostnet"]
EVM_STANDARDS = ["erc721", "erc1155"]
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"


def is_eth_address(c: Column) -> Column:
    return c.rlike(r"^0x[0-9a-fA-F]{40}$")


def is_tezos_address(c: Column) -> Column:
    return c.rlike(r"^tz[1-4][1-9A-HJ-NP-Za-km-z]{33}$") | is_kt1(c)


def is_kt1(c: Column) -> Column:
    return c.rlike(r"^KT1[1-9A-HJ-NP-Za-km-z]{33}$")


def normalise_address(c: Column) -> Column:
    """Lower case for 0x addresses, unchanged otherwise: the key by which addresses are equal."""
    return F.when(F.lower(F.substring(c, 1, 2)) == "0x", F.lower(c)).otherwise(c)


def packed(address: Column) -> tuple[Column, Column]:
    """(bytes, text) of an address, one of which is null: 0x and an even number of lower-case digits as bytes, any other as it is."""
    digits = F.startswith(address, F.lit("0x")) & (F.length(address) % 2 == 0) & (address == F.lower(address))
    found = F.when(digits, F.unhex(F.substr(address, F.lit(3))))
    return found, F.when(found.isNull(), address)


def unpacked(found: Column, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(found))), text)


def is_none_address(c: Column) -> Column:
    """Null, empty and the zero address all stand for nobody."""
    return c.isNull() | (c == "") | (F.lower(c) == ZERO_ADDRESS)


def is_evm(chain: Column) -> Column:
    return chain.isin(EVM_CHAINS)


def is_valid_chain(chain: Column) -> Column:
    return chain.isin(EVM_CHAINS + TEZOS_CHAINS)


def eip155_id(chain: Column) -> Column:
    return F.regexp_extract(chain, r"^eip155:([0-9]+)$", 1).try_cast("bigint")


def blockchain_of(address: Column) -> Column:
    return F.when(is_eth_address(address), "ethereum").when(is_tezos_address(address), "tezos")


def cid(chain: Column, standard: Column, contract: Column, number: Column) -> Column:
    return F.concat(chain, F.lit(":"), standard, F.lit(":"), contract, F.lit(":"), number)


def cid_parts(c: Column) -> Column:
    """chain, standard, contract and number; null unless there are five parts, the chain's two among them, or more."""
    p = F.split(c, ":")
    parts = F.struct(F.concat_ws(":", p[0], p[1]).alias("chain"), p[2].alias("standard"), p[3].alias("contract"), F.array_join(F.slice(p, 5, F.size(p)), ":").alias("number"))
    return F.when(F.size(p) >= 5, parts)


def cid_normalise(c: Column) -> Column:
    p = cid_parts(c)
    return F.when(p.isNotNull(), cid(p["chain"], p["standard"], normalise_address(p["contract"]), p["number"]))


def cid_valid(c: Column) -> Column:
    """EVM tokens are erc721 or erc1155 at a hex address, Tezos tokens fa2 at a KT1 address; the number is digits."""
    p = cid_parts(c)
    evm = is_evm(p["chain"]) & p["standard"].isin(EVM_STANDARDS) & is_eth_address(p["contract"])
    tezos = p["chain"].isin(TEZOS_CHAINS) & (p["standard"] == "fa2") & is_kt1(p["contract"])
    return F.coalesce((evm | tezos) & is_numeric(p["number"]), F.lit(False))


def is_numeric(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def is_positive_numeric(c: Column) -> Column:
    return is_numeric(c) & c.rlike("[1-9]")


def unsigned_to_long(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(is_numeric(trimmed), trimmed.try_cast("bigint"))


def did_pkh(address: Column, chain: Column) -> Column:
    return F.lower(F.concat(F.lit("did:pkh:"), chain, F.lit(":"), address))


def event_type(sender: Column, receiver: Column) -> Column:
    """From nobody is a mint, to nobody a burn, anything else a transfer."""
    return F.when(is_none_address(sender), "mint").when(is_none_address(receiver), "burn").otherwise("transfer")
