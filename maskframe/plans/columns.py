"""Which mask a column gets, judged by its name.

At plan time the names of a DataFrame are known, so `classify_column` is plain
Python over ``df.schema`` and costs nothing per row.  Where field names are
data (header cells, key/value tables) `classify_name` gives the same answer as
a Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.splice import let
from maskframe.functions import masks as M
from maskframe.functions.charset import WS


@dataclass(frozen=True)
class ColumnRule:
    name: str
    keys: tuple[str, ...]
    label: str | None
    mask: Callable[[Column], Column] | None
    # "vendors"/"depts": labelled by first appearance instead of by a mask.
    entity: str | None = None


def _rule(name, keys, label, mask, entity=None) -> ColumnRule:
    return ColumnRule(name, tuple(keys.split()), label, mask, entity)


# Keys in their order of precedence, and the finding label.
COLUMN_RULES: tuple[ColumnRule, ...] = (
    _rule("phone", "phone mobile tel cellphone 手机 电话 联系方式 联系电话 移动电话", "手机号", M.mask_phone),
    _rule("email", "email mail 邮箱 邮件 电子邮箱", "邮箱", M.mask_email),
    _rule("name", "name realname username fullname nickname displayname 姓名 名字 用户名 联系人 负责人 收件人 发件人"
                  " 当事人 客户姓名 乘客姓名", "姓名", M.mask_name),
    _rule("idcard", "idcard id_card identity identitycard 身份证 证件号 证件号码 身份证号", "身份证号", M.mask_id_card),
    _rule("bankcard", "bankcard bank_card cardno card_no accountno 银行卡 卡号 银行账号 账户 账号", "银行卡号", M.mask_bank),
    _rule("address", "address addr street location 地址 住址 收货地址 详细地址 通讯地址 户籍地址 家庭住址", "地址",
          M.mask_address),
    _rule("company", "company organization org corp 公司 企业 企业名称 集团 集团名称 基金 基金名称 雇主 工作单位",
          "企业/集团/基金名称", M.mask_company),
    _rule("vendor", "vendor supplier customer client merchant partner 供应商 客户 甲方 乙方 合作方 经销商 代理商 采购方"
                    " 销售方", "供应商/客户", None, "vendors"),
    _rule("department", "department dept division team businessunit 部门 事业部 业务线 团队 成本中心 科室 分支机构",
          "部门", None, "depts"),
    _rule("amount", "amount price salary revenue profit income expense cost budget fee total balance payment 金额 价格"
                    " 薪资 收入 支出 利润 营收 成本 费用 总价 余额 实付 应收 估值 融资 融资额 投资额 市值 营业额",
          None, M.mask_amount),
    _rule("uid", "uid userid user_id openid empid employeeid 用户ID 员工号 工号 会员ID", "用户ID", M.mask_uid),
    _rule("ip", "ip ipaddress ip_address clientip remoteip IP地址 服务器IP 服务器地址", "IP地址", M.mask_ipv4),
    _rule("birth", "birth birthday birthdate dob 出生日期 生日 出生年月 出生地", "出生日期", M.mask_birth_date),
    _rule("age", "age 年龄 岁", "年龄", M.mask_age),
    _rule("plate", "plate license_plate car_plate 车牌 车牌号 车辆牌照", "车牌号", M.mask_license_plate),
    _rule("contract", "contract contract_no contract_id 合同 合同号 合同编号", "合同编号", M.mask_contract),
    _rule("order", "order order_id orderno 订单 订单号 订单编号 流水号 交易号", "订单/流水号", M.mask_order),
    _rule("invoice", "invoice invoice_no invoice_id 发票 发票号 发票代码", "发票号码", M.mask_invoice),
    _rule("tax", "tax tax_id credit_code 统一社会信用代码 税号 信用代码 营业执照号", "统一社会信用代码", M.mask_social_credit),
    _rule("social", "social social_security housing_fund 公积金 社保 社保号 社保账号", "社保/公积金号", M.mask_housing_fund),
    _rule("medical", "medical medical_record record_no 病历 病历号 就诊号 住院号", "病历号", M.mask_medical_record),
    _rule("wechat", "wechat wechat_id wxid wx_id 微信 微信号 微信公众号", "微信/QQ号", M.mask_im_id),
    _rule("qq", "qq qq_id qq号 qqnumber", "微信/QQ号", M.mask_im_id),
)

RULES_BY_NAME = {rule.name: rule for rule in COLUMN_RULES}

# Further names, asked only when no key above fits.
SYNONYMS: tuple[tuple[str, str], ...] = tuple(
    (word, rule)
    for rule, words in (
        ("phone", "手机号码 电话号码 联系号码 phonenumber cellno contactphone"),
        ("name", "真实姓名 用户姓名 乘客名 旅客姓名 投保人 被保险人 受益人 操作员 创建者 提交者 审核人 经办人"
                 " personname contactname"),
        ("idcard", "id号码"),
        ("address", "居住地址 所在地址 收件地址 发件地址 注册地址 办公地址"),
        ("company", "所在单位 雇主名称 机构名称 品牌方 所属公司"),
        ("amount", "薪酬 工资 月薪 年薪 奖金 报酬 报销金额 实发金额 应发金额 税前工资 税后工资 到手工资 交易额 gmv arr"),
        ("bankcard", "开户账号 账户号码 开户行账号"),
        ("birth", "出生年月日"),
        ("department", "所属部门 归属部门 所在部门 所属事业部 所属业务线"),
        ("vendor", "甲方名称 乙方名称 合作方名称 供应商名称"),
    )
    for word in words.split()
)

# Blanks, joiners and full-width ASCII do not count in a name.
_NAME_NOISE = rf"[{WS}_\-！-～]"


def normalize_col_name(name: str) -> str:
    return re.sub(_NAME_NOISE, "", name.lower())


def normalize_name(name: Column) -> Column:
    """Column version of `normalize_col_name`."""
    return F.regexp_replace(F.lower(name), _NAME_NOISE, "")


def _ordered_keys() -> list[tuple[str, str]]:
    keys = [(normalize_col_name(key), rule.name) for rule in COLUMN_RULES for key in rule.keys]
    return keys + [(normalize_col_name(word), rule) for word, rule in SYNONYMS]


_ORDERED_KEYS = _ordered_keys()


def _name_parts(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [part.lower() for part in re.split(rf"[{WS}_\-./]+", spaced) if part]


def classify_column(name: str, mode: str = "substring") -> ColumnRule | None:
    """The first rule that fits a column name, or ``None``.

    ``substring`` looks for a key anywhere in the name, so ``shipdate`` counts
    as an ``ip`` column.  ``token`` wants whole name parts (``client_ip``) for
    Latin keys and avoids that; Chinese keys stay substrings in both.
    """
    if mode not in ("substring", "token"):
        raise ValueError(f"unknown mode {mode!r}")
    normal = normalize_col_name(name.strip())
    if mode == "substring":
        found = next((rule for key, rule in _ORDERED_KEYS if key in normal), None)
    else:
        parts = _name_parts(name.strip())
        runs = {"".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}
        found = next(
            (rule for key, rule in _ORDERED_KEYS if (key in runs if key.isascii() else key in normal)), None
        )
    return RULES_BY_NAME[found] if found else None


def classify_name(name: Column) -> Column:
    """Rule name for a field name held in a column; NULL when none fits."""

    def chosen(normal: Column) -> Column:
        chain = None
        # Neighbouring keys of one rule become one alternation.
        for rule, keys in groupby(_ORDERED_KEYS, key=lambda pair: pair[1]):
            pattern = "|".join(re.escape(key) for key, _ in keys)
            chain = (F if chain is None else chain).when(normal.rlike(pattern), F.lit(rule))
        return chain

    # Named once: the expression would carry the normalised name once for each rule.
    return let(normalize_name(name), chosen)


def mask_by_rule(rule: Column, value: Column, entities: dict[str, Callable[[Column], Column]]) -> Column:
    """Mask ``value`` by a rule name held in a column."""

    def chosen(bound: Column) -> Column:
        chain = None
        for known in COLUMN_RULES:
            masked = entities[known.entity](bound) if known.entity else known.mask(bound)
            chain = (F if chain is None else chain).when(rule == known.name, masked)
        return chain.otherwise(bound)

    return let(value, chosen)


def label_by_rule(rule: Column) -> Column:
    """Finding label of a rule name held in a column; NULL for pass-through rules."""
    pairs = [(r.name, r.label) for r in COLUMN_RULES if r.label]
    chain = F.when(rule == pairs[0][0], F.lit(pairs[0][1]))
    for name, label in pairs[1:]:
        chain = chain.when(rule == name, F.lit(label))
    return chain
