"""The code scanner on a file of each kind."""
from lodestone.sources import code

GO = '''package shop

import (
	"fmt"
	db "example.org/x/db"
)

type Store struct {
	n int
}

// func Commented() {}
func (s *Store) Load(id int) error {
	for i := 0; i < id; i++ {
		for range s.rows {
			if id > 3 && i == 2 { fmt.Println("func Fake() { if") }
		}
	}
	return s.check(id)
}

func (s *Store) check(id int) error { return db.Find(id) }

func routes(r Router) {
	r.GET("/orders/:id", showOrder)
	r.HandleFunc("POST /orders", h.Create)
}
'''
TS = '''import { a } from "./a";
const x = require('lib/x');
export class Cart extends Base implements Item, Other {
  private total(n: number): number {
    return this.sum(n) + helper(n);
  }
  sum(n: number) { return n ? n : 0; }
}
export async function helper(n) { while (n) { n--; } return fetchIt(n); }
const arrow = (v) => { helper(v); };
app.get('/carts/:id', listCarts);
'''
JAVA = '''package shop;
import java.util.List;
import static shop.Util.*;
public class Orders extends Base implements Repo<Order> {
    /* void gone() {} */
    @GetMapping("/orders/{id}")
    public Order show(long id) throws Missing {
        for (Order o : all()) { if (o.id == id || id < 0) { return o; } }
        return repo.find(id);
    }
    private List<Order> all() { return List.of(); }
}
'''
RUBY = '''require "json"
module Shop
  class Cart < Base
    def total(n)
      sum(n) if n
    end

    def self.sum(n)
      JSON.parse(n)
    end
  end
end
get "/carts", to: "carts#index"
'''
MORE = {
    "m/a.rs": ("use std::io;\npub struct S { x: i32 }\nimpl S {\n    pub fn run(&self) -> i32 { helper(1) }\n}\nfn helper(n: i32) -> i32 { n }\n#[get(\"/x\")]\nasync fn x() {}\n", {"m.S", "m.S.run", "m.helper", "m.x"}, {("m.S.run", "m.helper")}, {"GET /x"}),
    "m/b.kt": ("import a.b.C\nclass K : Base {\n    fun go(n: Int): Int { return other(n) }\n    private fun other(n: Int) = n\n}\n", {"m.K", "m.K.go", "m.K.other"}, {("m.K.go", "m.K.other")}, set()),
    "m/c.cs": ("using System.Linq;\npublic class P : Q {\n    [HttpGet(\"items\")]\n    public int Get(int n) { return Help(n); }\n    private static int Help(int n) { return n; }\n}\n", {"m.P", "m.P.Get", "m.P.Help"}, {("m.P.Get", "m.P.Help")}, {"GET items"}),
    "m/d.php": ("<?php\nuse App\\Models\\User;\nclass D {\n    public function show($id) { return $this->find($id); }\n    private function find($id) { return $id; }\n}\nRoute::get('/d', [D::class, 'show']);\n", {"m.D", "m.D.show", "m.D.find"}, {("m.D.show", "m.D.find")}, {"GET /d"}),
    "m/e.c": ("#include <stdio.h>\nstruct node { int v; };\nstatic int help(int n) {\n  return n;\n}\nint main(void) {\n  return help(1);\n}\n", {"m.node", "m.help", "m.main"}, {("m.main", "m.help")}, set()),
    "m/f.swift": ("import Foundation\npublic class V {\n    public func load() { helper() }\n    func helper() {}\n}\n", {"m.V", "m.V.load", "m.V.helper"}, {("m.V.load", "m.V.helper")}, set()),
    "m/g.scala": ("import a.b\nobject G {\n  def top(n: Int): Int = {\n    low(n)\n  }\n  private def low(n: Int) = n\n}\n", {"m.G", "m.G.top", "m.G.low"}, {("m.G.top", "m.G.low")}, set()),
    "m/h.dart": ("import 'package:x/x.dart';\nclass H extends Base {\n  int up(int n) { return down(n); }\n  static int down(int n) { return n; }\n}\n", {"m.H", "m.H.up", "m.H.down"}, {("m.H.up", "m.H.down")}, set()),
}


def facts(spark, files):
    return [r.asDict(True) for r in code.extract_code(spark.createDataFrame(files, "path string, body string")).collect()]


def edges(rows, kind):
    return {(r["name"], x["target"]) for r in rows for x in r["relations"] if x["kind"] == kind}


def test_go(spark):
    rows = facts(spark, [("shop/store.go", GO)])
    by = {r["name"]: r for r in rows if r["kind"] == "symbol"}
    assert set(by) == {"shop.Store", "shop.Store.Load", "shop.Store.check", "shop.routes"}
    assert edges(rows, "imports") == {("shop", "fmt"), ("shop", "example.org/x/db")}
    assert edges(rows, "calls") >= {("shop.Store.Load", "fmt.Println"), ("shop.Store.check", "db.Find")}
    load = by["shop.Store.Load"]
    assert (load["line"], load["end_line"], load["loop_depth"], load["cyclomatic"], load["exported"]) == (13, 20, 2, 5, True) and not by["shop.Store.check"]["exported"]
    assert {(r["name"], r["props"].get("handler")) for r in rows if r["kind"] == "route"} == {("GET /orders/:id", "showOrder"), ("POST /orders", "h.Create")}


def test_typescript(spark):
    rows = facts(spark, [("web/cart.ts", TS)])
    by = {r["name"]: r for r in rows if r["kind"] == "symbol"}
    assert set(by) == {"web.Cart", "web.Cart.total", "web.Cart.sum", "web.helper", "web.arrow"}
    assert edges(rows, "imports") == {("web", "./a"), ("web", "lib/x")} and edges(rows, "implements") == {("web.Cart", x) for x in ("Base", "Item", "Other")}
    assert edges(rows, "calls") >= {("web.Cart.total", "web.Cart.sum"), ("web.Cart.total", "web.helper"), ("web.helper", "fetchIt"), ("web.arrow", "web.helper")}
    assert by["web.helper"]["loop_depth"] == 1 and by["web.Cart"]["exported"] and {r["name"] for r in rows if r["kind"] == "route"} == {"GET /carts/:id"}


def test_java(spark):
    rows = facts(spark, [("src/Orders.java", JAVA)])
    by = {r["name"]: r for r in rows if r["kind"] == "symbol"}
    assert set(by) == {"src.Orders", "src.Orders.show", "src.Orders.all"}
    assert edges(rows, "imports") == {("src", "java.util.List"), ("src", "shop.Util.*")} and edges(rows, "implements") == {("src.Orders", "Base"), ("src.Orders", "Repo")}
    assert edges(rows, "calls") >= {("src.Orders.show", "src.Orders.all"), ("src.Orders.show", "repo.find"), ("src.Orders.all", "List.of")}
    assert by["src.Orders.show"]["cyclomatic"] == 4 and {r["name"] for r in rows if r["kind"] == "route"} == {"GET /orders/{id}"}


def test_ruby(spark):
    rows = facts(spark, [("lib/cart.rb", RUBY)])
    by = {r["name"]: r for r in rows if r["kind"] == "symbol"}
    assert set(by) == {"lib.Shop", "lib.Cart", "lib.Cart.total", "lib.Cart.sum"} and (by["lib.Cart"]["line"], by["lib.Cart"]["end_line"]) == (3, 11)
    assert edges(rows, "calls") == {("lib.Cart.total", "lib.Cart.sum"), ("lib.Cart.sum", "JSON.parse")} and edges(rows, "imports") == {("lib", "json")}
    assert {(r["name"], r["props"]["handler"]) for r in rows if r["kind"] == "route"} == {("GET /carts", "carts#index")}


def test_other_languages(spark):
    rows = facts(spark, [(p, v[0]) for p, v in MORE.items()] + [("m/z.txt", "class No {}"), ("m/empty.go", ""), ("m/null.ts", None)])
    for path, (_, symbols, calls, routes) in MORE.items():
        own = [r for r in rows if r["file"] == path]
        assert {r["name"] for r in own if r["kind"] == "symbol"} == symbols, path
        assert edges(own, "calls") >= calls, (path, edges(own, "calls"))
        assert {r["name"] for r in own if r["kind"] == "route"} == routes, path
        assert any(r["kind"] == "module" and r["relations"] for r in own), path
    assert not any(r["file"] == "m/z.txt" for r in rows) and sum(r["file"] in ("m/empty.go", "m/null.ts") for r in rows) == 2
