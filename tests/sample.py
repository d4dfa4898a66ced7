"""A small billing extract with every kind of dirt, and the ledger it must give."""

from __future__ import annotations

from datetime import date
from pathlib import Path

INVOICES = """invoice_id,customer_id,amount,status,invoice_date,due_date
1,11,70.30,paid,2025-03-01,2025-03-31
2,12,100.00, OVERDUE ,2025-03-02,2025-03-12
3,11,55.55,Pending,2025-03-03,2025-04-02
3,11,55.55,Pending,2025-03-03,2025-04-02
4,13,0.00,paid,2025-03-04,2025-03-05
5,14,12.50,,2025-03-05,2025-03-15
6,15,80.00,paid,2025-03-06,2025-03-01
7,99,64.00,overdue,2025-02-27,2025-03-02
8,12,9.99,pending,2025-03-08,2025-03-08
"""

CUSTOMERS = """customer_id,customer_name,country,segment,email
11," Harbour Bakery ",pt,SMB,Till@Harbour.example
12,"Lumen, Ltd.",ie,Enterprise,
13,,dk,startup,desk@mono.example
13,,dk,startup,desk@mono.example
14,Quay Works,,,ops@quay.example
15,Harbour Bakery,PT,smb,Till@Harbour.example
"""

LINES = """line_item_id,invoice_id,product_name,quantity,unit_price
1,1,Flour,7,10.01
2,1,Sample,1,0.00
3,1,Bag,1,0.23
1,2,Lamp,3,30.00
1,2,Lamp,2,30.00
1,3,Yeast,5,11.11
1,3,Yeast,5,11.11
1,4,Nothing,0,0.00
1,6,Rope,4,25.00
1,77,Lost,1,5.00
"""

# invoice, customer, name, country, segment, email, amount, status, issued, due,
# terms, lines, total, discrepancy
LEDGER = [
    (1, 11, "Harbour Bakery", "PT", "smb", "till@harbour.example", 70.3, "paid",
     date(2025, 3, 1), date(2025, 3, 31), 30, 3, 70.3, 0.0),
    (2, 12, "Lumen, Ltd.", "IE", "enterprise", None, 100.0, "overdue",
     date(2025, 3, 2), date(2025, 3, 12), 10, 1, 60.0, 40.0),
    (3, 11, "Harbour Bakery", "PT", "smb", "till@harbour.example", 55.55, "pending",
     date(2025, 3, 3), date(2025, 4, 2), 30, 1, 55.55, 0.0),
    (4, 13, None, "DK", "startup", "desk@mono.example", 0.0, "paid",
     date(2025, 3, 4), date(2025, 3, 5), 1, 1, 0.0, 0.0),
    (5, 14, "Quay Works", None, "unknown", "ops@quay.example", 12.5, "unknown",
     date(2025, 3, 5), date(2025, 3, 15), 10, 0, 0.0, 12.5),
    (6, 15, "Harbour Bakery", "PT", "smb", "till@harbour.example", 80.0, "paid",
     date(2025, 3, 6), date(2025, 3, 1), -5, 1, 100.0, -20.0),
    (7, 99, None, None, None, None, 64.0, "overdue",
     date(2025, 2, 27), date(2025, 3, 2), 3, 0, 0.0, 64.0),
    (8, 12, "Lumen, Ltd.", "IE", "enterprise", None, 9.99, "pending",
     date(2025, 3, 8), date(2025, 3, 8), 0, 0, 0.0, 9.99),
]


def write_extracts(folder: Path, **replaced: str) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    texts = {"invoices": INVOICES, "customers": CUSTOMERS, "invoice_line_items": LINES}
    for table, text in {**texts, **replaced}.items():
        (folder / f"{table}.csv").write_text(text, encoding="utf-8")
    return str(folder)
