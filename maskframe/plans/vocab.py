"""Word lists the text rules and the surname check work from.

All lists in this file are fixed values: results depend on them word for word.
"""

from __future__ import annotations

# Family names of one character, then of two.
SURNAMES = (
    *"赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨",
    *"朱秦尤许何吕施张孔曹严华金魏陶姜",
    *"戚谢邹喻柏水窦章云苏潘葛奚范彭郎",
    *"鲁韦昌马苗凤花方俞任袁柳酆鲍史唐",
    *"费廉岑薛雷贺倪汤滕殷罗毕郝邬安常",
    *"乐于时傅皮卞齐康伍余元卜顾孟平黄",
    *"和穆萧尹姚邵湛汪祁毛禹狄米贝明臧",
    *"计伏成戴谈宋茅庞熊纪舒屈项祝董梁",
    *"欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人".split(),
    *"夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶".split(),
    *"太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于".split(),
)

# Companies recognised without any suffix.
KNOWN_COMPANIES = tuple(
    name.replace("_", " ")
    for name in """
    美团 字节跳动 抖音 快手 拼多多 滴滴 滴滴出行
    小红书 知乎 微博 百度 阿里巴巴 腾讯 京东 网易
    华为 小米 OPPO vivo 荣耀 一加 魅族
    比亚迪 蔚来 小鹏 理想 零跑 哪吒
    商汤 旷视 依图 云从 寒武纪 地平线
    蚂蚁 陆金所 京东金融 度小满 微众银行 网商银行
    顺丰 菜鸟 京东物流 极兔 圆通 申通 韵达 中通
    携程 去哪儿 同程 飞猪 途牛
    爱奇艺 优酷 腾讯视频 B站 哔哩哔哩 芒果TV
    饿了么 盒马 叮咚买菜 每日优鲜
    贝壳 链家 安居客 房天下
    好未来 新东方 猿辅导 作业帮 掌门教育
    平安 中国平安 招商银行 工商银行 建设银行 农业银行 中国银行
    中信 光大 民生 浦发 兴业 华夏 广发
    东方财富 同花顺 雪球 老虎证券 富途
    Google Apple Microsoft Amazon Meta Netflix
    Tesla Nvidia Intel AMD Qualcomm Samsung
    Alibaba Tencent Baidu JD Meituan ByteDance
    Uber Lyft Airbnb Spotify Twitter LinkedIn
    Goldman_Sachs Morgan_Stanley JPMorgan BlackRock Sequoia
    红杉 高瓴 IDG 经纬 真格 源码 光速 启明 纪源
    软银 淡马锡 黑石 凯雷 贝恩 KKR TPG
    """.split()
)

# Industry words that end a Chinese company name.
INDUSTRY_SUFFIXES = tuple(
    """
    股份 控股 集团 资本 基金 投资 创投 风投 资管 资产 产业 实业 置业 地产 能源 电力 化工 医药 生物 农业
    矿业 航空 航运 物流 传媒 文化 教育 科技 网络 数据 云计算 人工智能 芯片 半导体 新能源 汽车 金融 证券
    银行 保险 信托 期货 租赁 担保 小贷 消费金融 供应链 贸易 进出口 建筑 工程 装饰 设计 咨询 律所 会所
    审计 评估 公关 广告 电商 零售 餐饮 酒店 旅游 健康 养老 体育 游戏 动漫 影视 出版 印刷 包装 纺织 服装
    鞋业 家居 家电 机械 设备 仪器 模具 铸造 钢铁 铝业 铜业 玻璃 陶瓷 塑料 橡胶 涂料 油漆 化妆品 日化
    食品 饮料 烟草 酒业 乳业 肉类 水产 粮油 饲料 种业 林业 牧业 渔业 环保 节能 水务 燃气 热力 通信 电信
    广电 卫星 航天 军工 核能 光伏 风电 储能 氢能
    """.split()
)

# Formal endings of company and institution names.
FORMAL_SUFFIXES = tuple(
    """
    有限公司 股份公司 有限责任公司 集团公司 企业集团 合伙企业 工作室 研究院 基金会 出版社 医院 学校 酒店
    商场 超市 农场 养殖场 工厂 矿山 基金管理公司 基金公司 资产管理 投资集团 实业集团 控股公司 科技公司
    技术公司 咨询公司 律师事务所 会计师事务所 评估公司 担保公司 租赁公司 融资公司 保理公司 信托公司
    证券公司 保险公司 经纪公司 代理公司 进出口公司 电商公司 网络公司 传媒公司 文化公司 旅游公司 建筑公司
    工程公司 装修公司 设计公司 农业公司 能源公司 化工公司 机械公司 电子公司 通信公司 软件公司 数据公司
    物流公司 供应链公司 贸易公司 外运公司 仓储公司 人力资源 商务咨询 企业咨询 管理咨询 产业发展 产业园区
    孵化器 加速器 投资管理 资本管理 私募基金 创业投资 风险投资 股权投资 并购基金 产业基金 政府引导基金
    """.split()
)

# Parameter names that are sensitive inside a URL query string.
URL_PARAMETERS = (
    "phone", "mobile", "email", "uid", "user_?id", "token", "access_?token", "id_?card", "name",
    "openid", "realname", "bankcard", "card_?no", "address", "password", "auth_?token",
    "refresh_?token", "api_?key",
)


def one_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def one_of_many(words) -> str:
    """``one_of`` for a long list, as a search tree over the first characters.

    The regex engine tries alternatives one by one; the tree asks a few range
    questions instead.  Words that share a first character keep their order, so
    the match is the one the flat list would give.
    """
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word)

    def tree(firsts: list[str]) -> str:
        if len(firsts) <= 2:
            return one_of(word for first in firsts for word in by_first[first])
        middle = len(firsts) // 2
        low, high = firsts[:middle], firsts[middle:]
        return f"(?:(?=[{low[0]}-{low[-1]}]){tree(low)}|(?=[{high[0]}-{high[-1]}]){tree(high)})"

    return tree(sorted(by_first))


def starting_with(letters: str) -> str:
    """A look-ahead over ASCII letters: one table lookup rejects most positions."""
    return f"(?=[{letters}])"
