"""One-way masks for single values: Column in, Column out, no UDF anywhere.

Every mask is a pure function of its input, so it partitions trivially, keeps
its place inside one projection and gives the same answer on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.charset import EOL, HAN, WS
from maskframe.functions.splice import let
from maskframe.functions.text import sha8, sha_prefix, trim_blanks

# The visible prefixes of the pseudonyms.
NAME_PREFIX = "用户_"
COMPANY_PREFIX = "公司_"
PROJECT_PREFIX = "项目_"
CONTRACT_PREFIX = "合同_"
ORDER_PREFIX = "单号_"
EMPLOYEE_PREFIX = "工号_"
HOUSING_FUND_PREFIX = "公积金_"
MEDICAL_RECORD_PREFIX = "病历号_"
SOCIAL_SECURITY_PREFIX = "社保_"
UID_PREFIX = "uid_"
VENDOR_PREFIX = "供应商_"
DEPT_PREFIX = "部门_"

# Constants that replace a whole value.
BIRTH_DATE_MASK = "****-**-**"
AGE_MASK = "**岁"
IPV6_MASK = "****:****:****:****"

# Leading administrative divisions of an address, then its rest.
_ADDRESS = (
    rf"^([{HAN}]{{2,4}}(?:省|市|自治区|特别行政区))?"
    rf"([{HAN}]{{2,10}}(?:市|区|县|州|旗))?([^{EOL}]*)"
)
# Province character, letter without I and O, and the tail.
_PLATE = rf"^([{HAN}])([A-HJ-NP-Z])([·・]?[A-HJ-NP-Z0-9]{{4,5}})"


def _stars(count: Column | int) -> Column:
    if isinstance(count, int):
        return F.lit("*" * count)
    return F.repeat(F.lit("*"), F.greatest(count, F.lit(0)))


def _first(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def _last(value: Column, n: int) -> Column:
    return F.right(value, F.lit(n))


def _keep_ends(value: Column, head: int, tail: int) -> Column:
    """Keep both ends and star out exactly what lies between them."""
    return F.concat(_first(value, head), _stars(F.length(value) - (head + tail)), _last(value, tail))


def mask_phone(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")

    def shape(d: Column) -> Column:
        hidden = F.least(F.length(d) - 7, F.lit(6))
        return (
            F.when(d.rlike(r"^1[3-9][0-9]{9}\z") | d.rlike(r"^[2-9][0-9]{9}\z"),
                   F.concat(_first(d, 3), _stars(4), _last(d, 4)))
            .when(F.length(d) >= 7, F.concat(_first(d, 3), _stars(hidden), _last(d, 4)))
            .otherwise(value)
        )

    return let(digits, shape)


def mask_id_card(value: Column, kind: str = "cnic") -> Column:
    if kind == "cnic":
        return F.concat(_first(value, 3), _stars(11), _last(value, 4))
    if kind == "hic":
        return F.concat(_first(value, 3), _stars(6), _last(value, 3))
    if kind == "hk":
        return F.concat(_first(value, 1), _stars(7), _last(value, 2))
    if kind == "tw":
        return F.concat(_first(value, 1), _stars(9))
    if kind == "macau":
        return F.concat(_first(value, 1), _stars(6))
    return F.when(F.length(value) >= 7, _keep_ends(value, 3, 4)).otherwise(value)


def mask_email(value: Column) -> Column:
    domain = F.substring_index(value, "@", -1)
    local = F.left(value, F.length(value) - F.length(domain) - 1)
    hidden = F.least(F.length(local) - 2, F.lit(8))
    masked_local = F.when(F.length(local) <= 2, F.concat(_first(local, 1), _stars(1))).otherwise(
        F.concat(_first(local, 1), _stars(hidden), _last(local, 1))
    )
    return F.when(F.contains(value, F.lit("@")), F.concat(masked_local, F.lit("@"), domain)).otherwise(value)


def mask_bank(value: Column) -> Column:
    return F.when(F.length(value) >= 8, _keep_ends(value, 4, 4)).otherwise(value)


def mask_tax(value: Column) -> Column:
    return F.when(F.length(value) >= 4, _keep_ends(value, 2, 2)).otherwise(value)


def mask_social_credit(value: Column) -> Column:
    return mask_tax(value)


def _pseudonym(prefix: str, value: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), sha_prefix(value, digits))


def mask_name(value: Column, digits: int = 4) -> Column:
    """Stable pseudonym; raise ``digits`` where 65 536 buckets are too few."""
    return _pseudonym(NAME_PREFIX, value, digits)


def mask_company(value: Column, digits: int = 4) -> Column:
    return _pseudonym(COMPANY_PREFIX, value, digits)


def mask_project(value: Column, digits: int = 6) -> Column:
    return _pseudonym(PROJECT_PREFIX, value, digits)


def sequence_label(prefix: str, position: Column) -> Column:
    """``prefix`` + A..Z for positions 1..26, then the plain number."""
    letter = F.char(F.lit(64) + position)
    return F.concat(F.lit(prefix), F.when(position <= 26, letter).otherwise(position.cast("string")))


def label_in(values: Column, value: Column, prefix: str) -> Column:
    """Label by the rank of ``value`` in an array of distinct values."""
    return sequence_label(prefix, F.array_position(values, value).cast("int"))


def mask_vendor(value: Column, seen: Column) -> Column:
    """Sequence label of a party, numbered by ``seen`` (distinct, first appearance first)."""
    return label_in(seen, value, VENDOR_PREFIX)


def mask_dept(value: Column, seen: Column) -> Column:
    return label_in(seen, value, DEPT_PREFIX)


def mask_amount(value: Column) -> Column:
    """Amounts are kept as they are."""
    return value


def mask_address(value: Column) -> Column:
    region = F.concat(F.regexp_extract(value, _ADDRESS, 1), F.regexp_extract(value, _ADDRESS, 2))
    rest = trim_blanks(F.regexp_extract(value, _ADDRESS, 3))
    starred = F.regexp_replace(_first(rest, 20), rf"[{HAN}0-9A-Za-z_]", "*")
    return F.when(F.length(rest) > 0, F.concat(region, starred)).otherwise(value)


def mask_contract(value: Column) -> Column:
    return _pseudonym(CONTRACT_PREFIX, value, 6)


def mask_order(value: Column) -> Column:
    return _pseudonym(ORDER_PREFIX, value, 8)


def mask_invoice(value: Column) -> Column:
    return F.when(F.length(value) > 6, _keep_ends(value, 4, 2)).otherwise(_stars(F.length(value)))


def mask_license_plate(value: Column) -> Column:
    known = F.concat(
        F.regexp_extract(value, _PLATE, 1),
        F.regexp_extract(value, _PLATE, 2),
        _stars(3),
        _last(F.regexp_extract(value, _PLATE, 3), 1),
    )
    return F.when(value.rlike(_PLATE), known).otherwise(
        F.concat(_first(value, 2), _stars(4), _last(value, 1))
    )


def mask_employee_id(value: Column) -> Column:
    return _pseudonym(EMPLOYEE_PREFIX, value, 6)


def _constant(value: Column, text: str) -> Column:
    return F.when(value.isNotNull(), F.lit(text))


def mask_birth_date(value: Column) -> Column:
    return _constant(value, BIRTH_DATE_MASK)


def mask_age(value: Column) -> Column:
    return _constant(value, AGE_MASK)


def mask_license_no(value: Column) -> Column:
    return _keep_ends(value, 2, 2)


def mask_housing_fund(value: Column) -> Column:
    return _pseudonym(HOUSING_FUND_PREFIX, value, 6)


def mask_medical_record(value: Column) -> Column:
    return _pseudonym(MEDICAL_RECORD_PREFIX, value, 6)


def mask_social_security(value: Column) -> Column:
    return _pseudonym(SOCIAL_SECURITY_PREFIX, value, 6)


def mask_uid(value: Column) -> Column:
    return F.concat(F.lit(UID_PREFIX), sha8(value))


def mask_ipv4(value: Column) -> Column:
    parts = F.split(value, r"\.", -1)
    return F.when(
        F.size(parts) == 4, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit(".*.*"))
    ).otherwise(value)


def mask_im_id(value: Column) -> Column:
    return F.when(F.length(value) > 6, F.concat(_first(value, 2), _stars(4), _last(value, 2))).otherwise(
        _constant(value, "****")
    )


def mask_passport(value: Column) -> Column:
    return F.concat(_first(value, 1), _stars(4), _last(value, 3))


def mask_travel_permit(value: Column) -> Column:
    return F.concat(_first(value, 2), _stars(4), _last(value, 4))


def mask_ipv6(value: Column) -> Column:
    return _constant(value, IPV6_MASK)


def mask_secret(value: Column) -> Column:
    return F.when(F.length(value) > 8, F.concat(_first(value, 3), _stars(4), _last(value, 3))).otherwise(
        _constant(value, "********")
    )


# Masks of one argument by public name; what the per-mask queries iterate over.
VALUE_MASKS = {
    mask.__name__: mask
    for mask in (
        mask_phone, mask_id_card, mask_email, mask_bank, mask_tax, mask_social_credit,
        mask_name, mask_company, mask_project, mask_amount, mask_address, mask_contract,
        mask_order, mask_invoice, mask_license_plate, mask_employee_id, mask_birth_date,
        mask_age, mask_license_no, mask_housing_fund, mask_medical_record,
        mask_social_security, mask_uid, mask_ipv4, mask_im_id, mask_passport,
        mask_travel_permit, mask_ipv6, mask_secret,
    )
}
