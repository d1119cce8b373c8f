from loomshift.plans import automap, export, plan
from loomshift.sources.catalog import Catalog, Column, ForeignKey, Table


def table(key, columns, pk, fks=(), rows=10):
    parts = [c.split(":") for c in columns.split(" ")]
    return Table(key, [Column(n, k, t, n not in pk, "i" in (m[0] if m else "")) for k, (n, t, *m) in enumerate(parts)], rows, None, list(pk), foreign_keys=[ForeignKey(f"FK{k}", [c], p, [q]) for k, (c, p, q) in enumerate(fks)])


def shop():
    source = [
        table("CUST", "CUST_ID:int:i CUST_NM:varchar(100) EMAIL_ADDR:varchar(120) PHONE_NO:varchar(30) DOB:datetime CRT_DT:datetime NOTES:text", ["CUST_ID"]),
        table("ADDR", "ADDR_ID:int:i CUST_ID:int LINE1:varchar(200) CITY:varchar(80) ZIP:varchar(12) CTRY_CD:char(2)", ["ADDR_ID"], [("CUST_ID", "CUST", "CUST_ID")]),
        table("PROD", "PROD_ID:int:i PROD_NM:varchar(150) PROD_DESC:varchar(500) UNIT_PRC:money ACTIVE_FLG:char(1)", ["PROD_ID"]),
        table("ORD_HDR", "ORD_ID:int:i CUST_ID:int ORD_DT:datetime TOTAL_AMT:money CMNT:varchar(500)", ["ORD_ID"], [("CUST_ID", "CUST", "CUST_ID")]),
        table("ORD_LINE", "ORD_ID:int LINE_NO:smallint PROD_ID:int QTY:int UNIT_PRC:money", ["ORD_ID", "LINE_NO"], [("ORD_ID", "ORD_HDR", "ORD_ID"), ("PROD_ID", "PROD", "PROD_ID")]),
        table("TMP_IMPORT", "X:int", [], rows=0),
    ]
    target = [
        table("Customers", "CustomerId:int:i FirstName:nvarchar(50) Email:nvarchar(120) Phone:nvarchar(30) BirthDate:date CreatedAt:datetime2(0) Notes:nvarchar(max)", ["CustomerId"]),
        table("Addresses", "AddressId:int:i CustomerId:int Line1:nvarchar(200) City:nvarchar(80) PostalCode:nvarchar(12) CountryCode:char(2)", ["AddressId"], [("CustomerId", "Customers", "CustomerId")]),
        table("Products", "ProductId:int:i Name:nvarchar(150) Description:nvarchar(500) UnitPrice:decimal(19,4) IsActive:bit", ["ProductId"]),
        table("Orders", "OrderId:int:i CustomerId:int OrderDate:datetime2(0) TotalAmount:decimal(19,4) Comment:nvarchar(200)", ["OrderId"], [("CustomerId", "Customers", "CustomerId")]),
        table("OrderLines", "OrderId:int LineNumber:smallint ProductId:int Quantity:int UnitPrice:decimal(19,4)", ["OrderId", "LineNumber"], [("OrderId", "Orders", "OrderId"), ("ProductId", "Products", "ProductId")]),
    ]
    return Catalog("src", {t.key: t for t in source}), Catalog("tgt", {t.key: t for t in target})


def test_automap_finds_the_pairs():
    source, target = shop()
    draft = automap.automap(source, target)
    assert {t: m["sources"][0] for t, m in draft["tables"].items()} == {"Customers": "CUST", "Addresses": "ADDR", "Products": "PROD", "Orders": "ORD_HDR", "OrderLines": "ORD_LINE"}
    found = {f"{t}.{c}": x["source_columns"][0] for t, m in draft["tables"].items() for c, x in m["columns"].items()}
    wanted = {"Customers.CustomerId": "CUST.CUST_ID", "Customers.Email": "CUST.EMAIL_ADDR", "Customers.Phone": "CUST.PHONE_NO", "Customers.BirthDate": "CUST.DOB", "Customers.Notes": "CUST.NOTES", "Addresses.PostalCode": "ADDR.ZIP", "Addresses.CountryCode": "ADDR.CTRY_CD", "Products.UnitPrice": "PROD.UNIT_PRC", "Orders.OrderDate": "ORD_HDR.ORD_DT", "Orders.Comment": "ORD_HDR.CMNT", "OrderLines.Quantity": "ORD_LINE.QTY", "OrderLines.LineNumber": "ORD_LINE.LINE_NO"}
    assert {k: found.get(k) for k in wanted} == wanted
    assert draft["drops"] == {"TMP_IMPORT": automap.EMPTY_REASON}
    assert plan.mapping_errors(draft, source, target) == [] and len(plan.generate(draft, source, target).tasks) == 5


def test_search_ranks_the_likely_columns_first():
    hits = automap.search(list(shop()), "customer email", k=3)
    assert {h[3] for h in hits[:2]} == {"Customers.Email", "CUST.EMAIL_ADDR"}
    assert automap.search(list(shop()), "qqq") == []


def test_exports():
    source, target = shop()
    made = plan.generate(automap.automap(source, target), source, target)
    assert export.script_pack(made) == export.script_pack(made) and "README.txt" in export.script_files(made)
    assert export.scrub("Server=x;Password=hunter22;a='o''b22'", ["o'b22"]) == "Server=x;Password=***;a='***'"
    assert export.text_listing("a\r\nb", "c") == [(1, "a"), (2, "b"), (3, "c")]
