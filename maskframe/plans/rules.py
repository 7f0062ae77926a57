"""The ordered text rules: what to find, how to mask it, what to call it.

Rules are data.  ``maskframe.operators.desensitize`` turns them into Column
expressions; order matters because each rule sees the text the previous one
left.  A rule also names a *gate*: a test that is much cheaper than the
pattern and holds on every text the pattern could match, so that a row without
digits or without Han letters never pays for the patterns that need them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions.charset import (
    EOL,
    HAN,
    NAME_CHARS,
    NOT_AFTER_DIGIT,
    NOT_AFTER_WORD,
    NOT_BEFORE_DIGIT,
    NOT_BEFORE_WORD,
    SEP,
    WS,
)
from maskframe.functions.splice import let
from maskframe.functions.text import is_ascii, luhn_valid, strip_sep
from maskframe.plans.vocab import (
    FORMAL_SUFFIXES,
    INDUSTRY_SUFFIXES,
    KNOWN_COMPANIES,
    URL_PARAMETERS,
    one_of,
    one_of_many,
    starting_with,
)

Mask = Callable[[Column], Column]


@dataclass(frozen=True)
class Gate:
    """A necessary condition on the text, shared by neighbouring rules.

    ``trace`` is a pattern or a test that holds on every text on which a rule
    behind the gate can match, now or after normalisation; without one the
    rules' own traces count.
    """

    name: str
    test: Mask
    trace: str | Mask | None = None


@dataclass(frozen=True)
class TextRule:
    """One rule.  Its replacement is ``kept part + mask(value)``.

    ``keep`` matches the head of a match that stays (a keyword and its
    separator); the value is what follows, or the whole match without ``keep``.
    """

    rule_id: str
    label: str
    pattern: str
    gate: Gate
    # Entity rules have no mask: theirs depends on the order of first appearance.
    mask: Mask | None = None
    keep: str | None = None
    # Cut blanks (and quotes) around the value.
    trimmed: bool = False
    valid: Mask | None = None
    entity: str | None = None
    # Words that announce the value where bare numbers are too ambiguous.
    keyword: str | None = None
    # Holds on every text with a match, if the gate has no trace.
    trace: str | Mask | None = None


# --------------------------------------------------------------------- gates

def _has(*needles: str) -> Mask:
    def test(text: Column) -> Column:
        found = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            found = found | F.contains(text, F.lit(needle))
        return found

    return test


def _has_lower(*needles: str) -> Mask:
    return lambda text: let(F.lower(text), _has(*needles))


_FOUR = "[0-9]{4}"
_ANY_HAN = f"[{HAN}]"
_CODE_18 = "[0-9A-HJ-NP-RT-Y]{18}"
_CHAT = starting_with("wWqQ") + "(?i:wechat|wxid|qq)"
_LEGAL_FORM = (
    rf"{starting_with('ICLPGSBNATHVEW')}(?<=[{WS}])(?:Inc|Corp|Ltd|LLC|L\.L\.C|Co\.|PLC|GmbH|S\.A|B\.V|N\.V|A\.G|Pty|Pte|Holding|Technolog"
    r"|Solution|System|Service|Venture|Partner|Investment|Enterprise|Industr|International|Global|Worldwide)"
)

ALWAYS = Gate("always", lambda text: F.lit(True))
AT_SIGN = Gate("at sign", _has("@"), _has("@"))
FOUR_DIGITS = Gate("four digits", lambda text: text.rlike(_FOUR), _FOUR)
SIX_DIGITS = Gate("six digits", lambda text: text.rlike("[0-9]{6}"), _FOUR)
CODE_18 = Gate("code of 18", lambda text: text.rlike(_CODE_18), _CODE_18)
SIXTEEN_DIGITS = Gate("sixteen digits", lambda text: text.rlike(rf"(?:[0-9]{{4}}[{WS}\-]?){{3}}[0-9]{{4}}"), _FOUR)
DOTTED_DIGITS = Gate("dotted digits", lambda text: text.rlike(r"[0-9]\.[0-9]"), r"[0-9]\.[0-9]")
HEX_COLON = Gate("hex colon", lambda text: F.contains(text, F.lit(":")) & text.rlike("[0-9a-fA-F]:[0-9a-fA-F]"),
                 lambda text: F.contains(text, F.lit(":")) & text.rlike("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"))
KEY_VALUE = Gate("key=value", _has("=", "："), _has("=", "："))
URL_QUERY = Gate("url query", lambda text: F.contains(text, F.lit("=")) & _has("?", "&")(text), _has("="))
HAN_TEXT = Gate("han", lambda text: ~is_ascii(text) & text.rlike(_ANY_HAN), lambda text: HAN_TEXT.test(text))
COMPANY_NEWS = Gate("company news", _has("完成", "获得", "宣布", "披露", "发布", "公告"), lambda text: HAN_TEXT.test(text))
ANCHOR_WORD = Gate("company anchor", _has("：", ":"), lambda text: HAN_TEXT.test(text) | _has("LP:", "GP:")(text))
CHAT_WORD = Gate("chat word", lambda text: text.rlike(_CHAT) | _has("微信")(text), lambda text: HAN_TEXT.test(text) | _has_lower("wechat", "wxid", "qq")(text))
LEGAL_FORM = Gate("english legal form", lambda text: text.rlike(_LEGAL_FORM), _LEGAL_FORM)
CAPITAL_CODE = Gate("capital code", lambda text: text.rlike("[A-Z]-[0-9]{4}"), _FOUR)
EIGHT_DIGITS = Gate("eight digits", lambda text: text.rlike("[0-9]{8}"), _FOUR)
INVOICE_WORD = Gate("invoice word", lambda text: text.rlike(starting_with("iI") + "(?i:invoice)") | _has("发票")(text), _FOUR)


# --------------------------------------------------------------- mask helpers

_TO_COLON = "^[^：:]*[：:]"
_TO_EQUALS = "^[^=：]*[=：]"
_TO_DIGIT = "^[^0-9]*"


def _labelled(rule_id: str, label: str, pattern: str, mask: Mask | None, gate: Gate = HAN_TEXT,
              keep: str = _TO_COLON, entity: str | None = None) -> TextRule:
    """Keyword, separator, value: the value is masked, keyword and separator stay."""
    return TextRule(rule_id, label, pattern, gate, mask, keep, trimmed=True, entity=entity)


def _key_value(rule_id: str, label: str, keys: str, value: str, mask: Mask) -> TextRule:
    return TextRule(rule_id, label, f"(?i)(?:{keys})[=：]{value}", KEY_VALUE, mask, _TO_EQUALS)


def _hide(value: Column) -> Column:
    return F.lit("****")


def _hide_quad(value: Column) -> Column:
    return F.lit("***.***.*.***")


def _mask_first_line(value: Column) -> Column:
    """An address value may run over a line break; only its first line is masked."""
    line = F.regexp_extract(value, f"^[^{EOL}]*", 0)
    return F.concat(M.mask_address(line), F.substring(value, F.length(line) + 1, F.length(value)))


def _is_octet_quad(m: Column) -> Column:
    return F.forall(F.split(m, r"\.", -1), lambda part: part.cast("int") <= 255)


def _mask_octet_quad(m: Column) -> Column:
    # Octets are numbers: leading zeros go.
    return M.mask_ipv4(F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mask_grouped_card(m: Column) -> Column:
    return M.mask_bank(_digits(m))


def _is_card(m: Column) -> Column:
    return luhn_valid(_digits(m))


def _mask_mainland_id(m: Column) -> Column:
    return M.mask_id_card(strip_sep(m), "cnic")


def _mask_short_id(m: Column) -> Column:
    return M.mask_id_card(strip_sep(m), "hic")


def _mask_hong_kong_id(m: Column) -> Column:
    return M.mask_id_card(m, "hk")


def _mask_taiwan_id(m: Column) -> Column:
    return M.mask_id_card(m, "tw")


def _mask_macau_id(m: Column) -> Column:
    return M.mask_id_card(m, "macau")


def _mask_investor(m: Column) -> Column:
    # The longest tail of name characters makes room for the pseudonym, so a
    # role joined by a bare verb is swallowed with the name.
    head = F.regexp_replace(m, rf"[{NAME_CHARS}]{{2,20}}\z", "")
    return F.concat(head, M.mask_company(F.regexp_extract(m, _INVESTOR, 1)))


def _mask_labelled_birth(m: Column) -> Column:
    return F.concat(F.regexp_extract(m, "^[^：:]*", 0), F.lit("：" + M.BIRTH_DATE_MASK))


def _mask_labelled_age(m: Column) -> Column:
    return F.concat(F.regexp_extract(m, "^[^：:]*", 0), F.lit("：**"))


def _mask_labelled_employee(m: Column) -> Column:
    number = F.regexp_extract(m, r"([A-Za-z0-9\-]{4,20})\z", 1)
    return F.concat(F.regexp_extract(m, "^[^：:]*", 0), F.lit("："), M.mask_employee_id(number))


def _is_license_no(m: Column) -> Column:
    return ~m.startswith("0")


def _is_order_no(m: Column) -> Column:
    """Neither phone-like nor an identity number."""
    identity = rf"^[0-9]{{6}}{_BIRTH_YEAR}{_MONTH}{_DAY}[0-9]{{3,4}}\z"
    return ~(m.rlike(r"^1[3-9][0-9]{13}\z") | m.rlike(identity))


_BIRTH_YEAR = "(?:19|20)[0-9]{2}"
_MONTH = "(?:0[1-9]|1[0-2])"
_DAY = "(?:0[1-9]|[12][0-9]|3[01])"

_SECRET = (
    starting_with("tarsbpTARSBP") + r"(?i)(?:token|access_?token|refresh_?token|api_?key|api_?secret|secret_?key|sk-|sk_|bearer|password|passwd"
    rf"|pwd|auth_?token|session_?id)[=＝{WS}:]+[\"']?([a-zA-Z0-9_\-.]{{6,128}})[\"']?"
)
# Parts of the words that announce a secret; a search for them costs less than the pattern.
_SECRET_PARTS = ("token", "key", "secret", "sk-", "sk_", "bearer", "passw", "pwd", "session")


def _has_secret(text: Column) -> Column:
    return _has_lower(*_SECRET_PARTS)(text) & text.rlike(_SECRET)


_SECRET_PREFIX = rf"^[^(=＝{WS}:)]+[=＝{WS}:]+"
# Only the start of a run, or where the match before ended, can start an e-mail: no start inside a run rescans it.
_EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_PHONE_SEP = rf"[{WS}\-./\\]?"
_LINE_START = rf"(?:\A|(?<=[{WS}，,、。；;]))"
_ANCHOR_START = rf"(?:\A|(?<=[{WS},、。；;]))"
_PARTY = f"([{NAME_CHARS}]{{2,20}})"
_ADDRESS_BODY = rf"([{HAN}A-Za-z0-9\-#{WS}]{{4,50}})"
_CHAT_ID = rf"(?i)(?:微信号?|微信ID|wechat|wxid|QQ号?|qq)[：:{WS}][{WS}]*([A-Za-z0-9_\-.]{{4,30}})"
_INVESTOR = (
    "(?:投资方|领投方|跟投方|FA机构|财务顾问|主承销商|联席承销商|保荐机构)(?:[：:]|[为是][：:]?)"
    rf"[{WS}]*([{NAME_CHARS}]{{2,20}})"
)
_ENGLISH_FORM_CORE = (
    rf"Inc\.?|Corp\.?|Ltd\.?|LLC|L\.L\.C\.|Co\.,?[{WS}]*Ltd\.?|PLC|GmbH|S\.A\.|B\.V\.|N\.V\.|A\.G\."
    rf"|Pty\.?[{WS}]*Ltd\.?|Pte\.?[{WS}]*Ltd\.?"
)
_KNOWN_FORM = (
    rf"(?:[{WS}]+(?:{_ENGLISH_FORM_CORE}|Holdings?|Group|Technologies?|Capital|Partners?|Ventures?|Investments?"
    r"|International|Global|Worldwide))?"
)
_ENGLISH_FORM = (
    rf"(?:[{WS}]+(?:{_ENGLISH_FORM_CORE}|Holdings?|Technologies?|Solutions?|Systems?|Services?|Ventures?|Partners?"
    r"|Investments?|Enterprises?|Industries?|International|Global|Worldwide))"
)
_COMPANY_NEWS = (
    "(?=(?:公司|集团|基金|品牌)?(?:完成|获得|宣布|披露|发布|公告)"
    rf"(?:[{HAN}A-Za-z0-9]+(?:元|美元|港元|欧元|英镑))?(?:融资|投资|上市|挂牌|并购|收购|战略合作))"
)

# Blanks inside a name may be line breaks until the text is normalised, so only its first word leaves a trace.
_KNOWN_START = rf"(?=[A-Zv{HAN}])(?<![{HAN}A-Za-z]){one_of_many(sorted({name.split(' ')[0] for name in KNOWN_COMPANIES}))}"

# Labels of the findings; fixed values.
COMPANY = "企业/集团/基金名称"
COMPANY_STRONG = "企业/集团/基金名称[强校验]"

TEXT_RULES: tuple[TextRule, ...] = (
    replace(_labelled("T01", "Token/密码/密钥", _SECRET, M.mask_secret, ALWAYS, _SECRET_PREFIX), trace=_has_secret),
    TextRule("T02", "邮箱", _EMAIL, AT_SIGN, M.mask_email),
    # -- numbers ------------------------------------------------------------
    TextRule("T03", "手机号",
             rf"{NOT_AFTER_DIGIT}(?:\+?86[{WS}\-]?)?1[3-9][0-9]{_PHONE_SEP}[0-9]{{4}}{_PHONE_SEP}[0-9]{{4}}{NOT_BEFORE_DIGIT}",
             FOUR_DIGITS, M.mask_phone),
    TextRule("T04", "座机号码", rf"{NOT_AFTER_DIGIT}0[0-9]{{2,3}}{_PHONE_SEP}[0-9]{{7,8}}{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_phone),
    TextRule("T05", "身份证号",
             f"{NOT_AFTER_DIGIT}[0-9]{{6}}{SEP}{_BIRTH_YEAR}{SEP}{_MONTH}{SEP}{_DAY}{SEP}[0-9]{{3}}{SEP}[0-9Xx]{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, _mask_mainland_id),
    TextRule("T06", "身份证号",
             f"{NOT_AFTER_DIGIT}[0-9]{{6}}{SEP}{_BIRTH_YEAR}{SEP}{_MONTH}{SEP}{_DAY}{SEP}[0-9]{{3}}{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, _mask_short_id),
    TextRule("T07", "港澳通行证/身份证", r"(?<![A-Za-z])[A-Z][0-9]{6}\([0-9A]\)(?![A-Za-z0-9])",
             SIX_DIGITS, _mask_hong_kong_id),
    TextRule("T08", "台湾身份证", "(?<![A-Za-z])[A-Z][0-9]{9}(?![A-Za-z0-9])",
             SIX_DIGITS, _mask_taiwan_id),
    TextRule("T09", "澳门身份证", rf"{NOT_AFTER_DIGIT}[1-6][0-9]{{6}}\([0-9]\){NOT_BEFORE_DIGIT}",
             SIX_DIGITS, _mask_macau_id),
    TextRule("T10", "护照号", f"(?<![A-Za-z])[EeGgDdSsPp][0-9]{{8}}{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_passport, keyword="护照|passport"),
    TextRule("T11", "港澳台通行证", f"(?<![A-Za-z])[HhMm][0-9]{{10}}{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_travel_permit),
    TextRule("T12", "驾驶证号", f"{NOT_AFTER_DIGIT}[0-9]{{12}}{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_license_no, valid=_is_license_no, keyword="驾驶证|驾照"),
    # A bare 17-18 digit number is too common, so this one needs its keyword.
    TextRule("T13", "社保卡号", rf"(?:社保卡号?|社保号|社保账号|社会保障号码?)[：:{WS}]*([1-9][0-9]{{16,17}}){NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_social_security, _TO_DIGIT),
    TextRule("T14", "公积金账号", rf"{NOT_AFTER_DIGIT}[0-9]{{10}}(?:[\- ][0-9]{{4,6}})+{NOT_BEFORE_DIGIT}",
             SIX_DIGITS, M.mask_housing_fund),
    TextRule("T15", "统一社会信用代码", "(?<![0-9A-Za-z])[0-9A-HJ-NP-RT-Y]{18}(?![0-9A-Za-z])",
             CODE_18, M.mask_tax, keyword="信用代码|税号"),
    TextRule("T16", "银行卡号",
             rf"{NOT_AFTER_DIGIT}[0-9]{{4}}[{WS}\-]?[0-9]{{4}}[{WS}\-]?[0-9]{{4}}[{WS}\-]?[0-9]{{4,7}}{NOT_BEFORE_DIGIT}",
             SIXTEEN_DIGITS, _mask_grouped_card, valid=_is_card),
    TextRule("T17", "银行卡号", f"{NOT_AFTER_DIGIT}[0-9]{{16,19}}{NOT_BEFORE_DIGIT}",
             SIXTEEN_DIGITS, M.mask_bank, valid=luhn_valid),
    TextRule("T18", "IP地址",
             rf"{NOT_AFTER_WORD}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}{NOT_BEFORE_WORD}",
             DOTTED_DIGITS, _mask_octet_quad, valid=_is_octet_quad),
    TextRule("T19", "IPv6地址", "(?<![:0-9A-Za-z_])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![:0-9A-Za-z_])",
             HEX_COLON, M.mask_ipv6),
    # -- key=value ----------------------------------------------------------
    _key_value("T20", "[kv]手机号", "phone|mobile|tel|cell", r"[+0-9\- ]{7,15}", _hide),
    _key_value("T21", "[kv]身份证号", "idcard|id_card|identity|cnic", "[0-9]{17}[0-9Xx]", _hide),
    _key_value("T22", "[kv]邮箱", "email|mail", _EMAIL, _hide),
    _key_value("T23", "[kv]姓名", "name|realname|username", rf"[{HAN}A-Za-z0-9_\-]{{2,20}}", M.mask_name),
    _key_value("T24", "[kv]用户ID", "uid|user_?id|openid|empid", r"[A-Za-z0-9_\-]{4,32}", M.mask_uid),
    _key_value("T25", "[kv]银行卡号", "bankcard|bank_card|card_?no|account", "[0-9]{16,19}", M.mask_bank),
    _key_value("T26", "[kv]地址", "address|addr", rf"[{HAN}A-Za-z0-9\-#,{WS}]{{5,50}}", _mask_first_line),
    _key_value("T27", "[kv]企业/集团/基金名称", "company|corp|org", f"[{NAME_CHARS}]{{2,20}}", M.mask_company),
    _key_value("T28", "[kv]Token/密钥", "token|api_?key|api_?secret|secret|pwd", r"[a-zA-Z0-9_\-.]{6,}",
               _hide),
    _key_value("T29", "[kv]IP地址", "ip_?addr|client_?ip|remote_?ip",
               r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", _hide_quad),
    TextRule("T30", "URL敏感参数", rf"(?i)[?&]{one_of(URL_PARAMETERS)}=[^&{WS}\"'<>]{{1,128}}", URL_QUERY,
             _hide, "^[^=]*="),
    # -- keyword: value -----------------------------------------------------
    _labelled("T31", "姓名",
              "(?:姓名|联系人|负责人|经办人|申请人|审批人|收件人|发件人|客户名|用户名|操作人|创建人|提交人|乘客|旅客"
              rf"|当事人|受益人|被保险人|投保人)[：:][{WS}]*([{HAN}]{{2,4}})", M.mask_name),
    _labelled("T32", "微信/QQ号", _CHAT_ID, M.mask_im_id, CHAT_WORD, rf"^[^：:{WS}]*[：:{WS}]"),
    _labelled("T33", "供应商/客户",
              _LINE_START + "(?:供应商|客户|甲方|乙方|合作方|承包商|分包商|经销商|代理商|采购方|销售方)"
              rf"[：:][{WS}]*{_PARTY}", None, entity="vendors"),
    _labelled("T34", "部门", rf"(?:部门|成本中心|事业部|业务线|团队|小组|分部|科室)[：:][{WS}]*{_PARTY}",
              None, entity="depts"),
    _labelled("T35", "项目名称", rf"(?:项目|工程|课题|专项)[：:][{WS}]*{_PARTY}", M.mask_project),
    # -- companies ----------------------------------------------------------
    TextRule("T36", COMPANY_STRONG,
             rf"(?=[A-Zv{HAN}])(?<![{HAN}A-Za-z]){one_of_many(KNOWN_COMPANIES)}{_KNOWN_FORM}(?![{HAN}A-Za-z])",
             ALWAYS, M.mask_company, trace=_KNOWN_START),
    TextRule("T37", COMPANY_STRONG,
             rf"[{HAN}]{{2,10}}{one_of_many(INDUSTRY_SUFFIXES)}(?:有限公司|股份公司|集团|公司)?",
             HAN_TEXT, M.mask_company),
    TextRule("T38", COMPANY_STRONG, rf"[A-Za-z][A-Za-z0-9{WS}\-&'.]{{1,40}}{_ENGLISH_FORM}(?=[^A-Za-z]|\z)",
             LEGAL_FORM, M.mask_company),
    TextRule("T39", COMPANY, rf"[{HAN}A-Za-z0-9]{{2,20}}{one_of_many(FORMAL_SUFFIXES)}",
             HAN_TEXT, M.mask_company),
    _labelled("T40", COMPANY,
              _ANCHOR_START + "(?:企业|集团|基金|公司|机构|品牌|品牌方|投资方|被投方|LP|GP)"
              rf"[：:][{WS}]*{_PARTY}", M.mask_company, ANCHOR_WORD),
    TextRule("T41", COMPANY, rf"[{HAN}A-Za-z0-9]{{2,15}}{_COMPANY_NEWS}", COMPANY_NEWS, M.mask_company),
    TextRule("T42", COMPANY, _INVESTOR, HAN_TEXT, _mask_investor),
    # -- addresses, dates, ages ---------------------------------------------
    _labelled("T43", "地址",
              rf"(?:收货地址|发货地址|详细地址|通讯地址|注册地址|办公地址)[：:][{WS}]*{_ADDRESS_BODY}", M.mask_address),
    _labelled("T44", "地址", _LINE_START + rf"(?:住址|地址)[：:][{WS}]*{_ADDRESS_BODY}", M.mask_address),
    TextRule("T45", "出生日期",
             rf"(?:出生日期|生日|出生年月)[：:][{WS}]*[0-9]{{4}}[年\-/.][0-9]{{1,2}}[月\-/.][0-9]{{1,2}}日?",
             HAN_TEXT, _mask_labelled_birth),
    TextRule("T46", "出生日期", rf"(?<![0-9_\-]){_BIRTH_YEAR}{_MONTH}{_DAY}(?![0-9_\-./\\])",
             EIGHT_DIGITS, M.mask_birth_date),
    TextRule("T47", "年龄", rf"(?:年龄|岁)[：:][{WS}]*[0-9]{{1,3}}", HAN_TEXT, _mask_labelled_age),
    # -- document numbers ---------------------------------------------------
    TextRule("T48", "合同编号", r"(?<![A-Za-z0-9])[A-Z]{2,6}-[0-9]{4,8}(?:[-.][0-9]{2,8})?(?![A-Za-z0-9])",
             CAPITAL_CODE, M.mask_contract),
    TextRule("T49", "订单/流水号", f"{NOT_AFTER_DIGIT}[0-9]{{14,25}}{NOT_BEFORE_DIGIT}", EIGHT_DIGITS, M.mask_order,
             valid=_is_order_no,
             keyword="订单|流水|交易号"),
    TextRule("T50", "发票号码", rf"(?i)(?:发票号码?|发票代码|invoice(?:_?no)?)[：:{WS}]*[0-9]{{8,12}}",
             INVOICE_WORD, M.mask_invoice, _TO_DIGIT),
    TextRule("T51", "工号", rf"(?i)(?:工号|员工号|员工编号)[：:][{WS}]*([A-Za-z0-9\-]{{4,20}})", HAN_TEXT, _mask_labelled_employee),
)

RULES_BY_ID = {rule.rule_id: rule for rule in TEXT_RULES}


def traces(rules) -> Mask:
    """A test that holds on every text on which any of the rules can match, as it is or normalised from narrow
    characters.  All patterns are looked for in one pass; a rule without a trace makes it hold everywhere."""
    found = list(dict.fromkeys(rule.gate.trace or rule.trace for rule in rules))
    if not found or None in found:
        return lambda text: F.lit(True)
    pattern = "|".join(f"(?:{trace})" for trace in found if isinstance(trace, str))
    tests = [trace for trace in found if not isinstance(trace, str)]

    def test(text: Column) -> Column:
        # The cheap searches first.
        held = [own(text) for own in tests] + ([text.rlike(pattern)] if pattern else [])
        return reduce(lambda a, b: a | b, held)

    return test


def require_keywords(rules: tuple[TextRule, ...]) -> tuple[TextRule, ...]:
    """Variants of the rules that fire on bare numbers: here they need their keyword first."""

    def guarded(rule: TextRule) -> TextRule:
        if rule.keyword is None:
            return rule
        lead = rf"(?i:(?:{rule.keyword})[^0-9A-Za-z{EOL}]{{0,8}})"
        return replace(rule, pattern=lead + rule.pattern, keep=f"^{lead}")

    return tuple(guarded(rule) for rule in rules)


def select_rules(only=None, without=None, keywords_required: bool = False) -> tuple[TextRule, ...]:
    """The rules in their order, by id or by label."""
    chosen = tuple(
        rule for rule in TEXT_RULES
        if (only is None or rule.rule_id in only or rule.label in only)
        and not (without and (rule.rule_id in without or rule.label in without))
    )
    return require_keywords(chosen) if keywords_required else chosen
