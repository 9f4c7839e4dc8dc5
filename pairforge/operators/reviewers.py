"""Sets of rules that read candidate pairs in place of a person: label and reason, the first rule that holds counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.operators.rules import decided

# Kinds of anchors that identify a seller by themselves.
DIRECT_KINDS = ("pgp_public_key", "pgp_fingerprint", "crypto_wallet", "telegram", "wickr", "jabber", "wechat", "qq", "bat", "phone", "email")
# Tokens that a parser takes for handles, places of public media, and signs of contacts and of goods in texts.
GENERIC_TOKENS = "(?i)^(?:app|application|before|contact|download|joinchat|mail|messenger|messgenger|private|store|support|telegram|wickr|w1ckr|wechat|whatsapp)$"
PUBLIC_MEDIA = r"(?i)(youtube\.com/watch|youtu\.be/|vimeo\.com|clear\s*net)"
DIRECT_CONTACTS = r"(?i)\b(telegram|wickr|wechat|jabber|qq|phone|crypto_wallet):"
SELLER_CONTACTS = r"(?i)(telegram|\btg\b|电报|飞机|纸飞机|wickr|wechat|微信|vx|wx|jabber|xmpp|qq|联系|联系方式|客服|咨询|合作|拍前|找我|加我)"
GOODS_DATA = "(?i)(数据格式|脱库|泄露|客户数据|银行卡数据|股民数据|彩票数据|邮箱|手机号|身份证|预留手机|测试数据|mega|网盘|源码|教程|自动发货|模板)"


def _zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def row_context(*columns: str) -> Column:
    """A row's texts with a blank between them; missing ones are empty."""
    return F.concat_ws(" ", *(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


def boundary_review(bucket: Column, retained: Column, identifier: Column, semantic: Column, structural: Column, category: Column, style_gap: Column, clone_signal: Column) -> Column:
    """Pairs near the boundary of a scorer, by their likeness of meaning, structure and style."""
    kept, semantic, gap = _zero(retained) > 0, _zero(semantic), _zero(style_gap)
    overlap = kept & (semantic >= 0.90) & (_zero(structural) >= 0.70) & (_zero(category) >= 0.75) & (gap <= 1.20) & (_zero(clone_signal) >= 1.0)
    return decided([
        (_zero(identifier) > 0, "positive", "direct_identifier_anchor"),
        ((bucket == "positive_probe_high_semantic_high_structure") & overlap, "uncertain", "strong_overlap_without_identity_anchor"),
        ((bucket == "negative_probe_high_semantic_style_divergence") & ~kept & (semantic >= 0.75) & (gap >= 2.20), "negative", "high_semantic_high_style_gap_negative"),
        (~kept & (semantic >= 0.80) & (gap >= 2.70), "negative", "unsupported_high_style_gap_negative"),
    ], ("uncertain", "insufficient_identity_closure"))


def anchor_review(kind: Column, token: Column, risk: Column, facing: Column, context: Column) -> Column:
    """Pairs that share a token of their items, "kind:value" or a value alone, by what stands around it on both sides."""
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    value = F.lower(F.trim(F.when(F.contains(token, F.lit(":")), F.substr(token, F.instr(token, ":") + 1)).otherwise(token)))
    return decided([
        (_zero(risk) > 0, "uncertain", "product_or_victim_data_risk"),
        (_zero(facing) <= 0, "uncertain", "weak_or_one_sided_seller_contact_context"),
        (value.rlike(GENERIC_TOKENS), "negative", "generic_parser_token"),
        (kind == "external_url", "uncertain", "support_only_external_url"),
        (kind.isin("wechat", "telegram") & context.rlike(PUBLIC_MEDIA), "negative", "public_media_id_not_seller_identity"),
        (kind.isin(*DIRECT_KINDS), "positive", "shared_seller_facing_direct_identifier"),
    ], ("uncertain", "unsupported_anchor_type"))


def targeted_review(contacts: Column, touches_proof: Column, context: Column) -> Column:
    """Pairs that a model scores highly: only a shared contact with a seller's words around it makes one positive."""
    return decided([
        ((F.trim(F.coalesce(contacts, F.lit(""))) != "") & contacts.rlike(DIRECT_CONTACTS) & context.rlike(SELLER_CONTACTS), "positive", "seller_facing_shared_direct_contact"),
        (F.coalesce(touches_proof.cast("string"), F.lit("")).isin("1", "true", "True"), "uncertain", "proof_anchor_neighbor_no_independent_direct_identity"),
        (context.rlike(GOODS_DATA), "uncertain", "product_or_template_overlap_no_identity_anchor"),
    ], ("uncertain", "model_high_score_without_identity_anchor"))


#: What ``source_review`` is told of a pair, as conditions.
SOURCE_FACTS = ("soft_same_alias", "fingerprint", "contact", "email", "direct", "facing", "goods", "template", "specific", "support", "alias_related", "placeholder")


def source_review(bucket: Column, titles: Column, descriptions: Column, facts: dict[str, Column]) -> Column:
    """Pairs of the source's own expansion, by the bucket that they were found in and the facts of ``SOURCE_FACTS``.

    ``titles`` and ``descriptions`` are numbers of shared ones; a fact that is missing does not hold.
    """
    is_ = {f: F.coalesce(facts.get(f, F.lit(False)), F.lit(False)) for f in SOURCE_FACTS}
    contact = bucket.isin("seller_facing_identifier_plus_text", "seller_facing_identifier_primary")
    clone, hard = bucket == "strong_text_clone_positive_probe", bucket == "english_hard_negative_template_probe"
    public = is_["template"] | is_["goods"]
    strong, stronger = (_zero(titles) >= 2) & (_zero(descriptions) >= 1), (_zero(titles) >= 3) & (_zero(descriptions) >= 2)
    return decided([
        (is_["soft_same_alias"], "uncertain", "soft_same_alias_excluded_from_primary_expansion"),
        (is_["fingerprint"], "positive", "shared_pgp_fingerprint_positive"),
        (contact & ~is_["contact"], "uncertain", "identifier_bucket_without_contact"),
        (contact & is_["goods"] & ~is_["facing"], "uncertain", "contact_inside_product_or_victim_data"),
        (contact & is_["direct"] & is_["facing"] & is_["support"], "positive", "seller_facing_im_or_phone_positive"),
        (contact & is_["email"] & is_["facing"] & is_["support"] & ~is_["goods"], "positive", "seller_facing_email_positive"),
        (contact & is_["email"] & is_["goods"], "uncertain", "email_product_data_ambiguous"),
        (contact, "uncertain", "contact_not_seller_facing_enough"),
        (clone & strong & is_["alias_related"] & ~public, "positive", "alias_related_text_clone_positive"),
        (clone & stronger & is_["specific"] & ~public, "positive", "seller_specific_operational_text_clone_positive"),
        (clone & public & ~is_["specific"], "uncertain", "public_or_product_template_clone"),
        (clone, "uncertain", "text_clone_without_identity_closure"),
        (hard & is_["contact"], "uncertain", "hard_negative_has_identifier_anchor"),
        (hard & is_["placeholder"], "negative", "generic_placeholder_hard_negative"),
        (hard & public, "negative", "public_template_hard_negative"),
        (hard & ~is_["alias_related"], "negative", "same_topic_no_identity_anchor_hard_negative"),
        (hard, "uncertain", "alias_related_hard_negative_uncertain"),
    ], ("uncertain", "unknown_en_source_expansion_bucket"))


def positive_anchor_review(bucket: Column, anchor: Column, lexical: Column, structural: Column, clone: Column, *, evidence: Column, facing: Column, victim: Column, wallet: Column, product_url: Column, own_url: Column) -> Column:
    """Pairs around anchors "kind:value" of proved identities, by bucket, support and what the texts around them say."""
    token, lexical, structural = F.lower(F.trim(F.coalesce(anchor, F.lit("")))), _zero(lexical), _zero(structural)
    kind = F.substring_index(token, ":", 1)
    said = lambda c: F.coalesce(c, F.lit(False))
    clone, facing, victim = said(clone), said(facing), said(victim)
    support, strong = clone | (lexical >= 0.05) | (structural >= 0.2), clone | (lexical >= 0.14) | (structural >= 0.5)
    identity = bucket.isin("supplemental_shared_seller_contact", "rare_identity_with_text_overlap")
    handles = kind.isin("telegram", "qq", "wickr", "wechat", "jabber", "phone")
    sure = F.contains(evidence, F.lit("strong_contact")) | F.contains(evidence, F.lit("cue_at_handle"))
    url, alias, known = bucket == "rare_external_url_with_text_overlap", bucket == "cross_market_unique_alias_closure", bucket == "direct_contact_existing_pending"
    started = token.startswith("telegram:") | token.startswith("qq:") | token.startswith("wechat:") | token.startswith("wickr:")
    return decided([
        (bucket == "positive_component_transitive_closure", "positive", "clean_positive_component_closure"),
        (identity & victim & ~facing, "uncertain", "identity_anchor_victim_data_context"),
        (identity & handles & said(sure) & facing & support, "positive", "seller_facing_shared_contact"),
        (identity & (kind == "crypto_wallet") & said(wallet) & strong, "positive", "seller_facing_shared_wallet"),
        (identity & (kind == "email") & facing & ~victim & strong, "positive", "seller_facing_shared_email"),
        (identity & (kind == "email"), "uncertain", "email_identity_ambiguous"),
        (identity, "uncertain", "identity_anchor_insufficient_context"),
        (url & (victim | said(product_url)), "uncertain", "external_url_victim_or_product_context"),
        (url & said(own_url) & strong & ~token.rlike("youtube|mega\\.nz|nordvpn|expressvpn|viewtopic"), "positive", "seller_operated_shared_url"),
        (url, "uncertain", "external_url_not_identity_definitive"),
        (alias & strong & ~victim, "positive", "cross_market_unique_alias_with_content_closure"),
        (alias, "uncertain", "cross_market_alias_insufficient_support"),
        (known & F.contains(token, F.lit("telegram:https")), "negative", "known_parser_noise_contact"),
        (known & (token.startswith("email:") | F.contains(token, F.lit(" email:"))), "uncertain", "email_inside_data_product"),
        (known & started & (clone | (lexical >= 0.1) | (structural >= 0.35)), "positive", "existing_direct_contact_with_support"),
        (known, "uncertain", "existing_direct_contact_without_support"),
    ], ("uncertain", "unknown_positive_anchor_bucket"))
